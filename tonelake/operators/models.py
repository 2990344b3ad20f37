"""What surrounds pluggable models: request policy and limiter, prompts, answers, logits. The models and the network are the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INSTRUCTIONS = (
    "Rate the mood of a developer's whole session. Answer with one JSON object and nothing else: {\"meanScore\": x}, x a finite number from -2.0 (very negative) to 2.0 "
    "(very positive). Commands, steps and code-like text are neutral unless the session plainly shows a mood. Don't explain, don't quote."
)


@dataclass(frozen=True)
class LLMScoringPolicy:
    max_messages: int = 200
    max_characters: int = 12_000
    max_requests_per_minute: int = 10
    timeout_seconds: float = 20.0
    max_output_tokens: int = 128
    store_responses: bool = False


class SessionScorer(Protocol):
    """Sends a prompt and gives the answer's body; raises on failure."""

    def __call__(self, instructions: str, prompt: str) -> str: ...


def answer_schema() -> dict[str, object]:
    """The strict JSON schema of an answer, for providers that take one: an object with just meanScore, within the scale."""
    score = {"type": "number", "minimum": -2.0, "maximum": 2.0}
    return {"type": "object", "properties": {"meanScore": score}, "required": ["meanScore"], "additionalProperties": False}


def model_location(names: Sequence[str], roots: Sequence[str], tokenizer: str = "tokenizer") -> tuple[str, str | None] | None:
    """The first of the names that is in one of the roots, and the tokenizer folder beside it, null without one; names are tried in order, each in all roots. Null where there is no model."""
    for name in names:
        for root in map(Path, roots):
            if (found := root / name).exists():
                beside = root / tokenizer
                return str(found), str(beside) if beside.is_dir() else None
    return None


def size_error(n_messages: Column, n_characters: Column, policy: LLMScoringPolicy) -> Column:
    """too_many_messages, input_too_large or null."""
    return F.when(n_messages > policy.max_messages, "too_many_messages").when(n_characters > policy.max_characters, "input_too_large")


def admitted(requests: DataFrame, at: str, order: str, by: str, policy: LLMScoringPolicy, error: str | None = None) -> DataFrame:
    """requests with a column ``status``: ok, rate_limited, or what the column ``error`` says; by: whose budget a request takes.

    A request is admitted if fewer than the allowed number were in the last 60 seconds; only admitted ones count, those exactly 60 seconds ago still do. The budget
    is full again after a pause of more than 60 seconds, so each run of requests without one is folded by itself."""
    ok = F.lit(True) if error is None else F.col(error).isNull()
    secs = F.unix_micros(F.col(at).cast("timestamp")) if dict(requests.dtypes)[at].startswith("timestamp") else (F.col(at) * 1_000_000).cast("long")
    rows = requests.withColumn("__t", secs).withColumn("__ok", ok)
    turn = Window.partitionBy(by).orderBy("__t", order)
    last = F.max(F.when(F.col("__ok"), F.col("__t"))).over(turn.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__new", F.coalesce((F.col("__t") - last > 60_000_000).cast("int"), F.lit(0))).withColumn("__run", F.sum("__new").over(turn.rowsBetween(Window.unboundedPreceding, 0)))
    schema = "array<struct<t:bigint,o:bigint>>"
    runs = rows.where("__ok").groupBy(by, "__run").agg(F.array_sort(F.collect_list(F.struct(F.col("__t").alias("t"), F.col(order).cast("bigint").alias("o")))).alias("r"))
    start = F.struct(F.array().cast("array<bigint>").alias("recent"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        recent = F.filter(acc["recent"], lambda y: y >= x["t"] - 60_000_000)
        free = F.size(recent) < policy.max_requests_per_minute
        return F.struct(F.when(free, F.concat(recent, F.array(x["t"]))).otherwise(recent).alias("recent"), F.when(free, F.concat(acc["taken"], F.array(x["o"]))).otherwise(acc["taken"]).alias("taken"))

    taken = runs.select(F.col(by).alias("__by"), F.explode(F.aggregate(F.col("r").cast(schema), start, step)["taken"]).alias("__o"))
    out = rows.join(taken, rows[by].eqNullSafe(taken["__by"]) & (rows[order] == taken["__o"]), "left")
    failed = F.lit(None).cast("string") if error is None else F.col(error)
    return out.withColumn("status", F.when(~F.col("__ok"), failed).when(F.col("__o").isNotNull(), "ok").otherwise("rate_limited")).drop("__t", "__ok", "__new", "__run", "__by", "__o")


def session_prompts(messages: DataFrame, metrics: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(session, n_messages, n_characters, prompt): the metrics, then the numbered messages."""
    own = messages.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))).alias("m"))
    numbered = F.array_join(F.transform("m", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["t"])), "\n")
    base = F.concat_ws("\n", F.lit("Computed by rules:"), *(F.concat(F.lit(f"- {n}: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for n, c in (("meanScore", "mean_score"), ("angryIndex", "angry_index"), ("patienceLevel", "patience"), ("language", "language"))))
    size = F.aggregate("m", F.lit(0), lambda a, x: a + F.length(x["t"]))
    return own.join(metrics.select(session, "mean_score", "angry_index", "patience", "language"), session).select(
        session, F.size("m").alias("n_messages"), size.alias("n_characters"), F.concat(base, F.lit("\n\nGive the corrected meanScore of the session as JSON, no comment.\n\nMessages:\n"), numbered).alias("prompt")
    )


def response_text(body: Column) -> Column:
    """The first text in an answer's body, in either provider's shape; null without any."""
    v = F.try_parse_json(body)
    a = F.flatten(F.transform(F.filter(F.try_variant_get(v, "$.output", "array<variant>"), lambda o: F.try_variant_get(o, "$.content", "array<variant>").isNotNull()), lambda o: F.try_variant_get(o, "$.content", "array<variant>")))
    pick = lambda c: F.filter(F.transform(c, lambda x: F.try_variant_get(x, "$.text", "string")), lambda t: t.isNotNull())
    return F.coalesce(F.get(pick(a), F.lit(0)), F.get(pick(F.try_variant_get(v, "$.content", "array<variant>")), F.lit(0)))


def parsed_score(json: Column) -> Column:
    """struct(score, error) of a JSON answer: error is invalid_response, invalid_score or null. true and false are no numbers."""
    v = F.try_variant_get(F.try_parse_json(json), "$.meanScore", "variant")
    number = F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    score = F.try_variant_get(v, "$", "double")
    error = F.when(v.isNull() | ~number, "invalid_response").when(F.isnan(score) | ~score.between(-2.0, 2.0), "invalid_score")
    return F.struct(F.when(error.isNull(), score).alias("score"), error.alias("error"))


def score_sessions(prompts: DataFrame, scorer: SessionScorer, session: str = "conv_id", policy: LLMScoringPolicy | None = None) -> DataFrame:
    """(session, mean_score, error): each prompt that keeps within the policy is sent from the executors; a failure is a row, not a failed job."""
    policy = policy or LLMScoringPolicy()
    kind = prompts.schema[session].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p in b["prompt"]:
                try:
                    out.append((scorer(INSTRUCTIONS, p), None))
                except Exception as e:  # a provider may fail in any way
                    out.append((None, f"request_failed: {e}"))
            yield pd.DataFrame({session: b[session], "body": [x for x, _ in out], "failed": [x for _, x in out]})

    checked = prompts.withColumn("__e", size_error(F.col("n_messages"), F.col("n_characters"), policy))
    sent = checked.where("__e is null").select(session, "prompt").mapInPandas(run, f"`{session}` {kind}, body string, failed string")
    answers = sent.withColumn("p", parsed_score(F.coalesce(response_text(F.col("body")), F.col("body")))).select(session, F.col("p.score").alias("mean_score"), F.coalesce("failed", "p.error").alias("error"))
    return answers.unionByName(checked.where("__e is not null").select(session, F.lit(None).cast("double").alias("mean_score"), F.col("__e").alias("error")))


def logit_score(logits: Column) -> Column:
    """(positive - negative) * 2 of the stable softmax over the last three logits (positive, neutral, negative), clamped; null with fewer or without a usable one."""
    three = F.slice(logits.cast("array<double>"), -3, 3)
    e = F.transform(three, lambda x: F.exp(x - F.array_max(three)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    score = F.when(total > 0, (e[0] - e[2]) / total * 2).otherwise(0.0)
    return F.when(F.size(logits) >= 3, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), score)))


def text_model(score: Callable[[list[str]], list[float | None]]) -> Callable[[DataFrame], DataFrame]:
    """A model for SentimentConfig.model from a function on texts; null or NaN leaves a message's score as it is."""

    def apply(df: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def run(text: pd.Series) -> pd.Series:
            return pd.Series(score(text.tolist()), dtype="float64", index=text.index)

        return df.withColumn("__m", run(F.col("__text"))).withColumn("model_score", F.when(~F.isnan("__m"), F.col("__m"))).drop("__m")

    return apply
