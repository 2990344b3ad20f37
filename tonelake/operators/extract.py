"""User messages out of session logs: filters, languages, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..sources.logs import ORDER, codex_history
from .language import log_language

IGNORED = ["<local-command-" + x + ">" for x in ("stderr", "stdout", "caveat")] + ["<task-notification>"]
LEAST_LENGTH = 8


def kept_content(text: Column, min_length: int = LEAST_LENGTH, include_slash_commands: bool = False) -> Column:
    """Not blank, not ignored by its prefix, no command, and long enough."""
    s = stripped(text)
    ok = (F.length(s) >= F.greatest(F.lit(1), F.lit(min_length))) & ~s.rlike("^(" + "|".join(IGNORED) + ")")
    return ok if include_slash_commands else ok & ~s.startswith("/")


def _with_language(df: DataFrame, language: str | None, assume_language: str | None) -> DataFrame:
    df = df.withColumn("language", F.lit(assume_language) if assume_language else log_language(F.col("content")))
    return df.where(F.col("language") == language) if language else df


def claude_messages(
    records: DataFrame, *, cwd_pattern: str | None = None, language: str | None = None, assume_language: str | None = None, min_length: int = LEAST_LENGTH, include_queue_ops: bool = False, include_slash_commands: bool = False
) -> DataFrame:
    """(path, block, at, project, session_id, timestamp, source_type, cwd, language, content) of claude_records."""
    user = (F.col("type") == "user") & ~F.col("is_meta") & (F.col("role") == "user")
    queued = (F.col("type") == "queue-operation") & (F.col("operation") == "enqueue")
    rows = records.where((user | queued) if include_queue_ops else user).where(F.col("content").isNotNull() & kept_content(F.col("content"), min_length, include_slash_commands))
    if cwd_pattern:
        rows = rows.where(F.col("cwd").contains(cwd_pattern))
    rows = _with_language(rows, language, assume_language)
    return rows.select(*ORDER, "project", "session_id", F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.col("type").alias("source_type"), "cwd", "language", stripped(F.col("content")).alias("content"))


def codex_messages(
    history: DataFrame, rollouts: DataFrame, threads: DataFrame, folders: DataFrame, *, cwd_pattern: str | None = None, language: str | None = None, assume_language: str | None = None, min_length: int = LEAST_LENGTH
) -> DataFrame:
    """(part, path, block, at, session_id, thread_name, timestamp, source, cwd, language, content): prompts of the history (part 0), then user messages of the rollouts (1)."""
    past = codex_history(history).join(folders, "session_id", "left").select(F.lit(0).alias("part"), *ORDER, "session_id", F.col("ts").alias("timestamp"), F.lit("history").alias("source"), "cwd", F.col("text").alias("content"))
    live = rollouts.where("type = 'event_msg' and payload_type = 'user_message'").select(
        F.lit(1).alias("part"), *ORDER, F.coalesce("session_id", F.lit("")).alias("session_id"), F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.lit("session_event").alias("source"), "cwd", F.col("message").alias("content")
    )
    rows = past.unionByName(live).join(threads.select("session_id", "thread_name"), "session_id", "left").withColumns({"thread_name": F.coalesce("thread_name", F.lit("")), "cwd": F.coalesce("cwd", F.lit("")), "content": stripped(F.col("content"))})
    rows = rows.where(F.length("content") >= F.greatest(F.lit(1), F.lit(min_length)))
    if cwd_pattern:
        rows = rows.where(F.col("cwd").contains(cwd_pattern))
    return _with_language(rows, language, assume_language).select("part", *ORDER, "session_id", "thread_name", "timestamp", "source", "cwd", "language", "content")
