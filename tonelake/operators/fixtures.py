"""Suggested test fixtures, from analysed messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lexicon import TYPES

MARGIN = 0.15


def category() -> Column:
    """mixed, profanity, frustration, positive or neutral, of the three lists."""
    p, f, g = (F.size(t) > 0 for t in TYPES)
    return F.when((p & (f | g)) | (f & g), "mixed").when(p, "profanity").when(f, "frustration").when(g, "positive").otherwise("neutral")


def _cents(x: Column) -> Column:
    """Two decimals, halves away from zero."""
    x = F.round(x, 10)
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def suggested(rows: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """(id, text, language, expected_*, expected_score_min, expected_score_max). lang: a column with the language to name (not the detected one); default en."""
    own = F.col(lang) if lang else F.lit("en")
    texts = (F.transform(t, lambda e: e["text"]).alias(f"expected_{t}") for t in TYPES)
    return rows.select(F.concat(own, F.lit("-"), category(), F.lit("-001")).alias("id"), F.col(text).alias("text"), own.alias("language"), *texts, _cents(F.col("score") - MARGIN).alias("expected_score_min"), _cents(F.col("score") + MARGIN).alias("expected_score_max"))


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Fixtures from JSON files, each an array of objects or one object. Without a schema it is inferred; a file that isn't JSON is an error."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def as_json(fixtures: DataFrame) -> DataFrame:
    """One JSON object a row, keys in order."""
    return fixtures.select(F.to_json(F.struct(*sorted(fixtures.columns))).alias("json"))
