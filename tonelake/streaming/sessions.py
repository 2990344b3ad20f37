"""Extension: live message analysis. Scoring holds no state; session metrics close with a pause, under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.analyze import SentimentConfig, analyze_messages


def live_scores(stream: DataFrame, cfg: SentimentConfig | None = None, text: str = "text", lang: str | None = None) -> DataFrame:
    """The batch expression, unchanged."""
    return analyze_messages(stream, cfg, text, lang)


def live_sessions(scored: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n_messages, mean_score, stddev, angry_index) of sessions that a pause of ``gap`` ends; rows later than ``late`` are dropped."""
    angry = F.size("profanity") + F.size("frustration")
    out = scored.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_messages"), F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("stddev"), (F.sum(angry) / F.count("*")).alias("angry_index"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_messages", "mean_score", "stddev", "angry_index")
