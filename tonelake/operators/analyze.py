"""Messages and sessions, from text to scores.

``analyze_messages`` adds columns and shuffles nothing; ``analyze_sessions`` needs one shuffle, by session.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import folded_tokens, opaque, raw_tokens
from ..lexicon import TYPES, Dictionary, Lexicon, builtin
from . import guard, language, match, rules

LEAST_MODEL_TOKENS, MOST_MODEL_SCORE = 8, 0.3
Scorer = Callable[[Column, Column], Column]  # (text, lang) -> score, null for none


@dataclass(frozen=True)
class SentimentConfig:
    """enable_*: layers. fallback, model: pluggable scorers of single messages; none are built in."""

    enable_keywords: bool = True
    enable_rules: bool = True
    enable_fallback: bool = True
    enable_model: bool = False
    fallback: Scorer | None = None
    model: Callable[[DataFrame], DataFrame] | None = None
    fallback_attenuation: float = 0.5
    additional_dictionaries: Sequence[Dictionary] = field(default_factory=tuple)

    def lexicon(self) -> Lexicon:
        return builtin().extended(self.additional_dictionaries)


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(-2.0), F.least(F.lit(2.0), c))


def with_tokens(df: DataFrame, text: str = "text", lang: str | None = "lang") -> DataFrame:
    """df with raw and norm, two token lists of equal length."""
    out = df.withColumn("raw", opaque(raw_tokens(F.col(text), F.col(lang) if lang else None))).withColumn("norm", opaque(folded_tokens(F.col("raw"))))
    # tokens that fold to nothing go
    keep = lambda c: F.when(F.array_contains("norm", ""), F.filter(F.col(c), lambda x, i: F.get(F.col("norm"), i) != "")).otherwise(F.col(c))
    return out.withColumns({"raw": opaque(keep("raw")), "norm": opaque(keep("norm"))})


def with_matches(df: DataFrame, cfg: SentimentConfig, lang: str = "lang", candidates: str | None = None) -> DataFrame:
    """df with a column ``matches``; candidates: a column that has them already, from match.found_by_join."""
    if not cfg.enable_keywords:
        return df.withColumn("matches", F.array().cast(f"array<{match.MATCH}>"))
    if candidates is None:
        df, candidates = df.withColumn("__candidates", match.found(F.col("norm"), F.col(lang), cfg.lexicon())), "__candidates"
    return df.withColumn("matches", opaque(match.without_overlap(F.col(candidates)))).drop(candidates)


def with_rules(df: DataFrame, cfg: SentimentConfig, text: str = "text") -> DataFrame:
    """df with ``ruled``, the matches as the rules see them, and with ``__score`` and ``intensity``."""
    own = rules.Rules.of(cfg.lexicon())
    if not cfg.enable_rules:
        plain = F.transform("matches", lambda m: F.struct(*(m[c].alias(c) for c in ("start", "end", "text", "type", "lang", "score")), F.lit(False).alias("negated"), F.lit(False).alias("caps"), m["score"].alias("adjusted")))
        return df.withColumn("ruled", plain).withColumn("__score", F.aggregate("ruled", F.lit(0.0), lambda a, m: a + m["adjusted"])).withColumn("intensity", F.lit(0.0))
    turn = opaque(F.when(F.size("matches") > 0, rules.turning_point(F.col("norm"), own)))
    df = df.withColumn("__turn", turn).withColumn("ruled", opaque(rules.adjusted(F.col("matches"), F.col("norm"), F.col("raw"), F.col("__turn"), own)))
    return df.withColumns({"__score": rules.message_score(F.col("ruled"), F.col(text)), "intensity": rules.message_intensity(F.col("ruled"), F.col(text))}).drop("__turn")


def analyze_messages(df: DataFrame, cfg: SentimentConfig | None = None, text: str = "text", lang: str | None = None) -> DataFrame:
    """df with language, score, intensity, profanity, frustration and positive. lang: a column with the language; without it, it is detected.

    Null text counts as empty. Existing columns of these names are replaced.
    """
    cfg = cfg or SentimentConfig()
    kept = [c for c in df.columns if c not in ("language", "score", "intensity", *TYPES)]
    df = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("__lang", F.col(lang)) if lang else language.detect(df, "__text", "__lang")
    inner = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("__row"), "__text", "__lang")  # no clash with the columns added here
    inner = with_rules(with_matches(with_tokens(inner, "__text", "__lang"), cfg, "__lang"), cfg, "__text")
    score = F.when(F.size("matches") > 0, clamped(F.col("__score")))
    if cfg.enable_fallback and cfg.fallback is not None:
        other = F.when(~guard.technical(F.col("__text"), F.col("norm")), cfg.fallback(F.col("__text"), F.col("__lang")))
        score = score.when(other.isNotNull() & ~F.isnan(other), clamped(other * cfg.fallback_attenuation))
    inner = inner.withColumn("__final", opaque(score.otherwise(0.0)))
    if cfg.enable_model and cfg.model is not None:
        inner = _modelled(inner, cfg)
    seen = F.filter("ruled", lambda m: ~m["negated"])
    return inner.select("__row.*", F.col("__lang").alias("language"), F.col("__final").alias("score"), "intensity", *(match.expressions(seen, t).alias(t) for t in TYPES))


def model_gate(tokens: Column, score: Column) -> Column:
    """Only longer messages of a weak score go to the model."""
    return (F.size(tokens) >= LEAST_MODEL_TOKENS) & (F.abs(score) < MOST_MODEL_SCORE)


def _modelled(inner: DataFrame, cfg: SentimentConfig) -> DataFrame:
    """The model sees only the rows that pass its gate: a Python function within a CASE would run for all of them.

    cfg.model: from a DataFrame with __text and __lang to one with a column model_score besides, in any order of rows."""
    gate = model_gate(F.col("norm"), F.col("__final"))
    scored = cfg.model(inner.where(gate)).withColumn("__final", F.coalesce("model_score", "__final")).drop("model_score")
    return inner.where(~gate).unionByName(scored)


def analyze_sessions(df: DataFrame, cfg: SentimentConfig | None = None, session: str = "conv_id", order: str = "turn", text: str = "text", lang: str | None = None) -> DataFrame:
    """One row for each session: n_messages, mean_score, stddev, index, patience, language, and top_expressions, the most frequent first."""
    rows = analyze_messages(df.select(session, order, text, *([lang] if lang else [])), cfg, text, lang)
    sample = language.detect(language.session_samples(df, session, order, text), "sample", "session_language").select(session, "session_language")
    return session_metrics(rows, session, order, sample)


def session_metrics(rows: DataFrame, session: str, order: str, sample: DataFrame | None = None) -> DataFrame:
    """As ``analyze_sessions``, of analysed messages. sample: (session, session_language), which fills in for messages without a language."""
    angry = F.size("profanity") + F.size("frustration")
    placed = rows.withColumn("__at", F.row_number().over(Window.partitionBy(session).orderBy(order))).withColumn("__angry", angry)
    if sample is None:
        sample = rows.select(session).distinct().withColumn("session_language", F.lit(None).cast("string"))
    own = sample.withColumnRenamed(session, "__session")
    placed = placed.join(own, placed[session].eqNullSafe(own["__session"]), "left").drop("__session").withColumn("__lang", F.coalesce("language", "session_language"))
    by_key = lambda c: F.transform(F.array_distinct(c), lambda x: F.struct(x.alias("x"), F.size(F.filter(c, lambda y: y == x)).alias("n")))
    out = placed.groupBy(session).agg(
        F.count("*").alias("n_messages"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("stddev"), (F.sum("__angry") / F.count("*")).alias("angry_index"),
        F.coalesce(F.min(F.when(F.col("__angry") > 0, F.col("__at"))), F.lit(0)).alias("patience"), F.max("session_language").alias("__sample"),
        F.collect_list(F.col("__lang")).alias("__langs"), F.flatten(F.collect_list(F.concat(*TYPES))).alias("__all"),
    )
    most = F.array_min(F.transform(by_key(F.col("__langs")), lambda x: F.struct((-x["n"]).alias("m"), x["x"].alias("lang"))))["lang"]
    top = F.transform(F.array_sort(F.transform(by_key(F.col("__all")), lambda x: F.struct((-x["n"]).alias("m"), x["x"].alias("e")))), lambda x: F.struct(x["e"]["text"].alias("text"), x["e"]["type"].alias("type"), x["e"]["language"].alias("language"), (-x["m"]).alias("n")))
    return out.select(session, "n_messages", "mean_score", "stddev", "angry_index", "patience", F.coalesce("__sample", most).alias("language"), top.alias("top_expressions"))


def with_empty_sessions(metrics: DataFrame, sessions: DataFrame, session: str = "conv_id") -> DataFrame:
    """metrics for all of ``sessions``: zeros, no language and no expressions for those without a message."""
    zeros = {"n_messages": F.lit(0), "mean_score": F.lit(0.0), "stddev": F.lit(0.0), "angry_index": F.lit(0.0), "patience": F.lit(0), "top_expressions": F.array().cast(metrics.schema["top_expressions"].dataType)}
    return sessions.select(session).distinct().join(metrics, session, "left").withColumns({c: F.coalesce(F.col(c), z) for c, z in zeros.items()})


def override_mean(metrics: DataFrame, scores: DataFrame, session: str = "conv_id") -> DataFrame:
    """metrics with the mean replaced by scores' ``mean_score``, clamped, where there is one; nothing else changes."""
    other = scores.select(F.col(session).alias("__session"), clamped(F.col("mean_score")).alias("__mean"))
    joined = metrics.join(other, metrics[session] == other["__session"], "left")
    return joined.withColumn("mean_score", F.when((F.col("n_messages") > 0) & F.col("__mean").isNotNull(), F.col("__mean")).otherwise(F.col("mean_score"))).select(*metrics.columns)


def top_expressions(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., text, type, language, n) of analysed messages."""
    return rows.select(*by, F.explode(F.concat(*TYPES)).alias("e")).groupBy(*by, "e").agg(F.count("*").alias("n")).select(*by, "e.text", "e.type", "e.language", "n")
