"""Candidate expressions mined from messages by regular expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stripped
from ..sources.sinks import markdown

BUCKETS = ["profanity", "frustration", "must_not_match", "positive"]
_CONTINUED = "This session is being continued from a previous conversation"


@dataclass(frozen=True)
class CandidateRule:
    phrase: str
    bucket: str
    kind: str
    rationale: str

    @property
    def pattern(self) -> str:
        return rf"(?iU)\b{self.phrase}\b"


RULES = (
    CandidateRule("está bien", "positive", "review", "mostly a plain yes to a step; unclear"),
    CandidateRule("hasta los cojones", "profanity", "keep", "a coarse way to be fed up"),
    CandidateRule("hay un problema", "must_not_match", "review", "says what is there, without a feeling"),
    CandidateRule("la puta madre", "profanity", "keep", "an outburst that has no technical sense"),
    CandidateRule("ni hablar", "frustration", "keep", "a firm refusal"),
    CandidateRule("no me convence", "frustration", "keep", "a negative verdict in clean words"),
    CandidateRule("perfecto", "positive", "review", "praise, but often a mere acknowledgement"),
    CandidateRule("qué raro", "frustration", "keep", "mild annoyance over something odd"),
)


def mining_input(rows: DataFrame, content: str = "content") -> DataFrame:
    """rows without blank texts and summaries of continued sessions; line ends become blanks."""
    s = stripped(F.coalesce(F.col(content), F.lit("")))
    ok = (s != "") & ~s.contains(_CONTINUED) & ~s.startswith("Analysis:") & ~s.startswith("Summary:")
    return rows.where(ok).withColumn(content, F.replace(s, F.lit("\n"), F.lit(" ")))


def read_mining(spark: SparkSession, *paths: str) -> DataFrame:
    """(source, content, cwd, session_id) of extractors' JSON lines, filtered; malformed lines are an error."""
    df = spark.read.schema("content string, cwd string, session_id string").option("mode", "FAILFAST").json(list(paths))
    return mining_input(df.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source"), "content", F.coalesce("cwd", F.lit("")).alias("cwd"), F.coalesce("session_id", F.lit("")).alias("session_id")))


def rule_hits(messages: DataFrame, order: Sequence[str], content: str = "content", rules: Sequence[CandidateRule] = RULES, max_examples: int = 3) -> DataFrame:
    """(phrase, bucket, kind, n, examples): for each rule with a hit the number of messages, and the first texts in order.

    Rules are columns, not rows to join with: a message is tested in one pass, and only hits are exploded."""
    tests = F.filter(F.array(*(F.when(F.col(content).rlike(r.pattern), F.lit(i)) for i, r in enumerate(rules))), lambda x: x.isNotNull())
    hits = messages.select(*order, F.col(content).alias("__content"), F.explode(tests).alias("rule"))
    n = hits.groupBy("rule").agg(F.count("*").alias("n"))
    # the rank limit is applied within each task before anything is shuffled
    ranked = hits.withColumn("__r", F.row_number().over(Window.partitionBy("rule").orderBy(*order, "__content"))).where(F.col("__r") <= max_examples)
    first = ranked.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__content"))), lambda x: x["__content"]).alias("examples"))
    return _named(n.join(first, "rule", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>"))), rules)


def _named(first: DataFrame, rules: Sequence[CandidateRule]) -> DataFrame:
    name = lambda a: F.element_at(F.array(*(F.lit(getattr(r, a)) for r in rules)), F.col("rule") + 1).alias(a)
    return first.select(name("phrase"), name("bucket"), name("kind"), name("rationale"), "n", "examples")


def project(cwd: Column) -> Column:
    """The folder below the first one called code, or unknown."""
    parts = F.filter(F.split(cwd, "/"), lambda p: p != "")
    return F.coalesce(F.when(F.array_position(parts, "code") > 0, F.try_element_at(parts, (F.array_position(parts, "code") + 1).cast("int"))), F.lit("unknown"))


def context_stats(messages: DataFrame, source: str, cwd: str, top_sources: int = 5, top_projects: int = 10) -> DataFrame:
    """(kind, key, n): the total, then the most frequent sources and projects; ties go to the least key, a null source is unknown."""
    each = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("messages").alias("key")), F.struct(F.lit("source").alias("kind"), F.coalesce(source, F.lit("unknown")).alias("key")), F.struct(F.lit("project").alias("kind"), project(F.col(cwd)).alias("key"))
    )
    n = messages.select(F.explode(each).alias("x")).groupBy("x").agg(F.count("*").alias("n")).select("x.kind", "x.key", "n")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))
    most = F.when(F.col("kind") == "source", top_sources).when(F.col("kind") == "project", top_projects).otherwise(1)
    return n.withColumn("__r", place).where(F.col("__r") <= most).drop("__r")


def report(hits: DataFrame, n_messages: int) -> str:
    """Markdown, by bucket, the most frequent first. hits are as many as there are rules."""
    rows = sorted(hits.collect(), key=lambda r: (BUCKETS.index(r.bucket), -r.n, r.phrase))
    sections = {b: [(f"`{r.phrase}` ({r.n} hits, {r.kind})", r.rationale, *(f"`{e[:220]}`" for e in r.examples)) for r in rows if r.bucket == b] for b in BUCKETS}
    return markdown("Mined candidates", {"Messages": n_messages}, sections)
