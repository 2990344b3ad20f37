"""Which expressions of a lexicon are exercised, and which are named but unknown: set algebra on (text, type, language)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_expression
from ..lexicon import Lexicon

KEY = ["text", "type", "language"]


def keys(df: DataFrame) -> DataFrame:
    """Distinct folded keys."""
    return df.select(fold_expression(F.col("text")).alias("text"), "type", "language").distinct()


def lexicon_keys(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    return spark.createDataFrame([(e.text, e.type, e.lang) for e in lexicon.entries], "text string, type string, language string").distinct()


def exercised(*sources: DataFrame) -> DataFrame:
    """The union of keys."""
    out = keys(sources[0])
    for s in sources[1:]:
        out = out.unionByName(keys(s))
    return out.distinct()


def phantom(lexicon: DataFrame, seen: DataFrame) -> DataFrame:
    """Lexicon keys that nothing exercises."""
    return lexicon.join(seen, KEY, "left_anti")


def unconsumed(lexicon: DataFrame, seen: DataFrame) -> DataFrame:
    """Exercised keys that the lexicon doesn't have."""
    return seen.join(lexicon, KEY, "left_anti")


def known(lexicon: DataFrame, seen: DataFrame) -> DataFrame:
    return seen.join(lexicon, KEY, "left_semi")


def coverage(lexicon: DataFrame, seen: DataFrame) -> DataFrame:
    """(language, n_lexicon, n_seen, n_phantom, coverage): for each language, and in all with a null language. n_seen counts keys of either side that are exercised."""
    both = lexicon.withColumn("__l", F.lit(True)).join(seen.withColumn("__s", F.lit(True)), KEY, "full_outer")
    in_lex, in_seen = F.coalesce("__l", F.lit(False)), F.coalesce("__s", F.lit(False))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return both.rollup("language").agg(n(in_lex).alias("n_lexicon"), n(in_seen).alias("n_seen"), n(in_lex & ~in_seen).alias("n_phantom"), F.round(F.try_divide(n(in_lex & in_seen) * 100.0, n(in_lex)), 1).alias("coverage"))
