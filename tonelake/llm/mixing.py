"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target share of the sample's tokens; its documents' inclusion probability is what gives that share in expectation (1 at most;
what a source is short of goes to the others, in proportion). The sample is balanced within every source: as many documents, and as many
tokens, as expected. The flight phase moves three fractional probabilities at a time along the null space of their two constraints
(documents, tokens) until one is 0 or 1, at random so that no expectation changes. It runs in blocks of ``block`` documents of one source; each block
leaves two documents at most, and those are the next level's input, until one block a source is left. There the landing phase drops the
token constraint, then the document constraint, for the last two documents.

Levels follow from the sources' counts. A document's random place comes from a hash of its id, and each block's moves from a hash of source, level
and block, so a recomputed task gives the same sample.

Cases: ties of places go by the id as a string. A text is counted whole, however long. Rows with equal id are one unit (its source is the least of theirs, its tokens are their sum): all stay or all go. A null id is a unit too, a null source
a source like any other. Null or empty text has 0 tokens and takes part. A source without tokens is not sampled: its probability is 0. Weights of sources
that are not there are ignored; sources without a weight have weight 0. An empty table gives an empty result. Blocks of fewer than four documents are an error. Columns besides id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

FRACTION, TEMPERATURE, BLOCK, SEED = 0.5, 0.5, 10_000, 11
_EPS = 1e-9


def probabilities(tokens: Mapping[str | None, int], weights: Mapping[str | None, float], fraction: float) -> dict[str | None, float]:
    """Each source's inclusion probability for a sample of fraction * all tokens with the given shares, as far as sources have enough."""
    left, open_, out = fraction * sum(tokens.values()), {s for s, t in tokens.items() if t > 0 and weights.get(s, 0) > 0}, dict.fromkeys(tokens, 0.0)
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] / total * left >= tokens[s]}
        if not full:
            out |= {s: weights[s] / total * left / tokens[s] for s in open_}
            break
        out |= dict.fromkeys(full, 1.0)
        left -= sum(tokens[s] for s in full)
        open_ -= full
    return out


def flight(p: list[float], tokens: list[float], random, balance_tokens: bool = True) -> list[float]:
    """Cube flight of probabilities with the document (and token) constraint; leaves at most two (one) that are not 0 or 1."""
    p = list(p)
    need = 3 if balance_tokens else 2
    active: list[int] = []
    rest = iter([i for i, x in enumerate(p) if _EPS < x < 1 - _EPS])
    draw = iter(random(len(p) + 3).tolist())
    while True:
        while len(active) < need and (nxt := next(rest, None)) is not None:
            active.append(nxt)
        if len(active) == 3:
            i, j, k = active
            a, b, c = tokens[j] - tokens[k], tokens[k] - tokens[i], tokens[i] - tokens[j]  # orthogonal to (1, 1, 1) and to the tokens
            move = [(i, a), (j, b), (k, c)] if a or b or c else [(i, 1.0), (j, -1.0)]
        elif len(active) == 2 and (not balance_tokens or tokens[active[0]] == tokens[active[1]]):
            move = [(active[0], 1.0), (active[1], -1.0)]
        else:
            return p
        up = min((1 - p[x]) / u if u > 0 else p[x] / -u for x, u in move if u)
        down = min(p[x] / u if u > 0 else (1 - p[x]) / -u for x, u in move if u)
        step = up if next(draw, 0.5) * (up + down) < down else -down
        for x, u in move:
            p[x] += step * u
            if p[x] < _EPS:
                p[x] = 0.0
            elif p[x] > 1 - _EPS:
                p[x] = 1.0
        active = [x for x in active if 0 < p[x] < 1]


def _run(seed: int, level: int, last: bool):
    def block(key: tuple, units: pd.DataFrame) -> pd.DataFrame:
        units = units.sort_values(["place", "order"], kind="stable", ignore_index=True)
        source = "" if key[0] is None else f"s{key[0]}"
        random = np.random.default_rng([seed, level, zlib.crc32(source.encode()), int(key[1])]).random
        tokens = units["n_tokens"].astype(float).tolist()
        p = flight(units["p"].tolist(), tokens, random)
        if last:
            p = flight(p, tokens, random, balance_tokens=False)
            p = [x if x in (0.0, 1.0) else float(random() < x) for x in p]
        units["p"] = p
        return units

    return block


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *, weights: Mapping[str | None, float] | None = None,
    fraction: float = FRACTION, temperature: float = TEMPERATURE, block: int = BLOCK, seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, n_tokens, inclusion, selected) for every distinct id. Tokens are words between white space.

    weights: target token shares of the sources, in any unit; default: each source's tokens to the power ``temperature``.
    fraction: the sample's tokens as a share of all tokens.
    """
    if block < 4:
        raise ValueError("block must be 4 at least: each block leaves two documents, and two blocks must become one")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens"))
    units = written_units(rows)
    plan, most = source_plan(units, weights, fraction, temperature)
    levels = [-(-most // block)]
    plan = plan.withColumn("n0", F.ceil(F.col("n") / block).cast("long"))
    while levels[-1] > 1:
        levels.append(-(-2 * levels[-1] // block))
        plan = plan.withColumn(f"n{len(levels) - 1}", F.ceil(F.col(f"n{len(levels) - 2}") * 2 / block).cast("long"))
    plan = written(plan.drop("n"), "plan")  # Spark chooses the join by its size: it has a row for each source
    joined = units.join(plan, units["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    state = joined.withColumn("place", F.xxhash64("id", F.lit(seed))).withColumn("order", F.coalesce(F.col("id").cast("string"), F.lit(""))).withColumn("p", F.col("inclusion"))
    settled: list[DataFrame] = []
    for i in range(len(levels)):
        last = i == len(levels) - 1
        sizes = state.columns
        split = state.withColumn("block", F.pmod(F.xxhash64("order", F.lit(seed + 1 + i)), F.col(f"n{i}")))
        out = split.groupBy("source", "block").applyInPandas(_run(seed, i, last), split.schema).select(*sizes)
        if not last:
            out = written(out, "flight")
            settled.append(out.where("p <= 0 or p >= 1"))
            out = out.where("p > 0 and p < 1")
        state = out
    for part in settled:
        state = state.union(part)
    return state.select(F.col("id").alias("doc_id"), "source", "n_tokens", "inclusion", (F.col("p") > 0.5).alias("selected"))


def source_plan(units: DataFrame, weights: Mapping[str | None, float] | None, fraction: float, temperature: float) -> tuple[DataFrame, int]:
    """(source, n, inclusion) for each source, by the rule of ``probabilities``, and the largest n.

    A source of t tokens and weight w is full where t <= w * level, else its inclusion is w * level / t. The level rises until no more sources are full; each turn is one aggregate."""
    spark = units.sparkSession
    sources = units.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    if weights is None:
        sources = sources.withColumn("w", F.when(F.col("t") > 0, F.pow(F.col("t").cast("double"), F.lit(temperature))).otherwise(0.0))
    else:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "given string, w double")
        sources = sources.join(given, sources["source"].eqNullSafe(given["given"]), "left").select("source", "t", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    sources = written(sources, "sources")
    total, most = sources.agg(F.sum("t"), F.max("n")).first()
    level, full = 0.0, -1
    while True:
        fits = F.col("t") <= F.col("w") * level
        now, held, rest = sources.where("t > 0 and w > 0").agg(F.count_if(fits), F.sum(F.when(fits, F.col("t"))), F.sum(F.when(~fits, F.col("w")))).first()
        if now == full or not rest:
            break
        full, level = now, max(level, (fraction * total - (held or 0)) / rest)
    inclusion = F.when((F.col("t") > 0) & (F.col("w") > 0), F.least(F.lit(1.0), F.col("w") * level / F.col("t"))).otherwise(0.0)
    return sources.select("source", "n", inclusion.alias("inclusion")), most or 0


def written_units(rows: DataFrame) -> DataFrame:
    """One row for each id, as a written table: it is read once for the totals and once for the flight."""
    return written(rows.groupBy("id").agg(F.min("source").alias("source"), F.sum("n_tokens").alias("n_tokens")), "units")


def keep_mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """docs with the same columns: the rows of the selected ids."""
    chosen = mix_sources(docs, doc_id, text, source, **how).where("selected").select(F.col("doc_id").alias(free_name(docs, "__id"))).hint("shuffle_hash")
    return docs.join(chosen, docs[doc_id].eqNullSafe(chosen[chosen.columns[0]]), "left_semi")
