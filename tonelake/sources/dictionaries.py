"""Dictionary files as rows, with what is wrong with each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import fold_expression, stripped
from ..lexicon import TYPES


def read_dictionaries(spark: SparkSession, path: str) -> DataFrame:
    """(path, lang, type, ord, expression, score, error): a row for each data line of the files; error is null, or the kind of lexicon.LexiconError that the line makes."""
    return dictionary_rows(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def dictionary_rows(files: DataFrame) -> DataFrame:
    """As ``read_dictionaries``, of (path, value) with whole files."""
    split = files.select("path", F.posexplode(F.split("value", r"\r\n|[\n\r\x0B\x0C\u0085\u2028\u2029]")).alias("ord", "raw")).withColumn("line", stripped(F.col("raw")))
    meta = split.where("line like '#%'").select("path", "ord", stripped(F.regexp_extract("line", r"^#([^:]*):", 1)).alias("name"), stripped(F.regexp_extract("line", r"^#[^:]*:(.*)$", 1)).alias("value"))
    head = meta.groupBy("path").agg(*(F.max_by("value", F.when(F.col("name") == n, F.col("ord"))).alias(c) for n, c in (("language", "lang"), ("type", "type"))))
    data = split.where("line <> '' and line not like '#%'").withColumn("tab", F.instr("line", "\t"))
    rows = data.select("path", "ord", "line", "tab", F.when(F.col("tab") > 0, stripped(F.expr("left(line, tab - 1)"))).otherwise(F.col("line")).alias("expression"), F.expr("try_cast(trim(substring(line, tab + 1)) as double)").alias("score"))
    rows = rows.join(head, "path", "left").withColumn("expression", fold_expression(F.col("expression")))
    again = F.row_number().over(Window.partitionBy("path", "expression").orderBy("ord")) > 1
    error = (
        F.when(F.coalesce("lang", F.lit("")) == "", "missing_language").when(F.coalesce("type", F.lit("")) == "", "missing_type").when(~F.col("type").isin(*TYPES), "invalid_type").when(F.col("tab") == 0, "missing_separator")
        .when(F.col("expression") == "", "empty_expression").when(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")), "invalid_score").when(again, "duplicate_expression")
    )
    return rows.select("path", "lang", "type", "ord", "expression", "score", error.alias("error"))


def unfolded(rows: DataFrame, expression: str = "expression") -> DataFrame:
    """The rows whose expression differs from its folded form, with that form as ``folded``."""
    return rows.withColumn("folded", fold_expression(F.col(expression))).where(F.col("folded") != F.col(expression))
