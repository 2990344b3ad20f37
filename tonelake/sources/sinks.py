"""Extracted messages as JSON lines or tab-separated text, and reports as Markdown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 200


def first_rows(df: DataFrame, order: Sequence[str], limit: int | None) -> DataFrame:
    """The output limit: the first rows in order; with None all rows, unordered."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object on a line; null fields are written."""
    df.write.option("ignoreNullFields", "false").json(path)


def tsv_rows(df: DataFrame) -> DataFrame:
    """df with tabs and line ends of all texts as blanks."""
    return df.select(*(F.translate(f"`{n}`", "\t\n", "  ").alias(n) if t == "string" else F.col(f"`{n}`") for n, t in df.dtypes))


def write_tsv(df: DataFrame, path: str) -> None:
    tsv_rows(df).write.csv(path, sep="\t", header=True, quote="", escape="", emptyValue="")


def markdown(title: str, totals: Mapping[str, object], sections: Mapping[str, Sequence[Sequence[object]]]) -> str:
    """A report of collected, small results: totals, then a list for each section; empty sections go."""
    out = [f"# {title}", "", *(f"- {k}: {v}" for k, v in totals.items())]
    for name, rows in sections.items():
        if rows:
            out += ["", f"## {name}", *("- " + ": ".join(map(str, r)) for r in rows)]
    return "\n".join(out) + "\n"


def duration(seconds: float) -> str:
    """Hours and minutes."""
    h, m = divmod(int(seconds // 60), 60)
    return f"{h}h {m}m" if h else f"{m}m"
