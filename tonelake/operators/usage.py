"""Usage rollups of session logs: a row for each session, counters in long form, and histograms.

Counters are (session, kind, key, n) rows, so totals and top lists of any kind are one more group-by.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import stripped
from ..sources.logs import ORDER
from ..sources.sinks import markdown

TOPICS_A = {
    "bbedit": r"\bbbedit\b", "blog": r"draft|borrador|art[ií]culo|post|\bblog\b", "claude": r"\bclaude\b", "codex": r"\bcodex\b", "ghostty": r"ghostt[iy]", "linear": r"ticket|backlog|issue|\blinear\b",
    "review": r"revisa|review", "tmux": r"\btmux\b", "traducción": r"transla(te|tion)|traduc", "worktrees": r"worktree",
}
TOPICS_B = {
    "blog": r"draft|art[ií]culo|post|\bblog\b", "claude": r"\bclaude\b", "codex": r"\bcodex\b", "linear": r"backlog|ticket|issue|\blinear\b", "python": r"\bpython\b", "review": r"revisa|review",
    "sentiment": r"dictionary|lexicon|nlp|sentiment", "swift": r"xcode|swiftpm|\bswift\b", "tests": r"pbt|testing|tests|\btest\b", "worktrees": r"worktree",
}
STOP_A = "ahora como con de del donde el en esta está esto hacer la las lo los luego mas me mi muy más nada para pero por porque puede puedo que quiero sin sobre solo tengo tiene todo tu un una unas uno unos y".split()
STOP_B = [w for w in STOP_A if w not in "donde luego muy nada tengo tiene".split()]
WORD = r"(?U)\b\w{3,}\b"
ASCII_WORD = "[0-9A-Za-z_]"
UNKNOWN = "unknown"


def _ascii(pattern: str) -> str:
    """The pattern with word borders as RE2 has them: only ASCII letters, digits and _ make words. Java's own borders see other letters too."""

    def plain(m: re.Match) -> str:
        if m[1]:  # before a letter: it is looked for first, as the border is dearer
            return f"(?={m[1]})(?<!{ASCII_WORD}){m[1]}"
        return f"(?:(?<={ASCII_WORD})(?!{ASCII_WORD})|(?<!{ASCII_WORD})(?={ASCII_WORD}))" if m[2] == "b" else m[0]

    return re.sub(r"\\(?:b([0-9A-Za-z_])(?![?*{])|(.))", plain, pattern)


def topics(text: Column, patterns: Mapping[str, str], ascii_borders: bool = False) -> Column:
    """The names whose pattern is in the text, in any case. ascii_borders: a letter such as ä is no part of a word, as in SQL; else it is, as in the original."""
    low, of = F.lower(text), _ascii if ascii_borders else "(?U){}".format
    return F.filter(F.array(*(F.when(low.rlike(of(p)), n) for n, p in sorted(patterns.items()))), lambda x: x.isNotNull())


def url_hosts(text: Column) -> Column:
    """The host of each URL, in lower case: all up to the next slash, with port and user."""
    return F.transform(F.regexp_extract_all(text, F.lit(r'https?://(?=[^\s)>"])([^\s)>"/]*)'), F.lit(1)), lambda x: F.lower(x))


def slash_command(text: Column) -> Column:
    s = stripped(text)
    return F.when(s.startswith("/"), F.element_at(F.split(s, r"(?U)\s+"), 1))


def words(text: Column, stop: Sequence[str]) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(list(stop)))


def top(df: DataFrame, k: int | None, *by: str, n: str = "n") -> DataFrame:
    """The k greatest n, on ties the least of ``by``."""
    out = df.orderBy(F.desc(n), *by)
    return out if k is None else out.limit(k)


def histogram(df: DataFrame, list_column: Column, key: str) -> DataFrame:
    """(key, n) of the members of a list column."""
    return df.select(F.explode(list_column).alias(key)).groupBy(key).agg(F.count("*").alias("n"))


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """(kind, key, n) for day, weekday and hour in UTC, whatever the session's time zone; null times are unknown."""
    t = F.col(ts)
    if dict(df.dtypes)[ts] == "timestamp":
        t = F.convert_timezone(None, F.lit("UTC"), t.cast("timestamp_ntz"))
    each = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(F.date_format(t, f), F.lit(UNKNOWN)).alias("key")) for k, f in (("day", "yyyy-MM-dd"), ("weekday", "EEEE"), ("hour", "HH"))))
    return df.select(F.explode(each).alias("x")).groupBy("x").agg(F.count("*").alias("n")).select("x.kind", "x.key", "n")


def _kind(name: str, key: Column) -> Column:
    """Counter entries of one kind, from a string or a list of them; null and empty count nothing."""
    return F.transform(F.filter(key, lambda x: x.isNotNull() & (x != "")), lambda x: F.struct(F.lit(name).alias("kind"), x.alias("key")))


def claude_sessions(records: DataFrame, index: DataFrame | None = None, cwd_pattern: str | None = None) -> DataFrame:
    """One row for each file of claude_records. index: resolve_sessions' rows, whose times and texts win over the log's; their files are the only ones then.

    cwd_pattern: files with no record in such a folder are left out."""
    user = (F.col("type") == "user") & F.col("content").isNotNull() & ~F.col("is_meta")
    queued = (F.col("type") == "queue-operation") & (F.col("operation") == "enqueue") & F.col("content").isNotNull()
    answer = F.col("type") == "assistant"
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    of = lambda c, n: F.sum(F.when(c, F.col(n)).otherwise(0)).alias(n)
    ts = F.try_to_timestamp("timestamp")
    out = records.groupBy("path").agg(
        F.first("project").alias("project"), F.first("file_id").alias("file_id"), count(user).alias("user_messages"), count(queued).alias("queue_messages"), count(answer).alias("assistant_messages"), of(answer, "tool_uses"),
        of((F.col("type") == "system") & (F.col("subtype") == "turn_duration"), "duration_ms"), *(of(answer, c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.min_by("content", F.when(user & (F.col("content") != ""), F.struct("block", "at"))).alias("prompt"), *([F.max(F.col("cwd").contains(cwd_pattern)).alias("__in")] if cwd_pattern else []),
    )
    if cwd_pattern:
        out = out.where("__in").drop("__in")
    if index is not None:
        out = out.join(index, "path")
    else:
        none = F.lit(None)
        out = out.withColumns({"session_id": F.col("file_id"), "created": none.cast("timestamp"), "modified": none.cast("timestamp"), "summary": F.lit(""), "first_prompt": F.lit("")})
    first = F.coalesce(F.nullif("first_prompt", F.lit("")), "prompt", F.lit(""))
    return out.withColumns({
        "first_prompt": first, "message_count": F.col("user_messages") + F.col("assistant_messages") + F.col("queue_messages"), "created": F.coalesce("created", "first_ts"), "modified": F.coalesce("modified", "last_ts"),
        "summary": F.coalesce(F.nullif("summary", F.lit("")), F.substring(first, 1, 120)),
    }).drop("file_id", "first_ts", "last_ts", "prompt")


def claude_counters(records: DataFrame, patterns: Mapping[str, str] | None = None, ascii_borders: bool = False) -> DataFrame:
    """(path, kind, key, n): folders, permission modes, models, topics, slash commands and URL hosts of each file."""
    patterns = patterns or TOPICS_A
    said = F.when(((F.col("type") == "user") & ~F.col("is_meta")) | ((F.col("type") == "queue-operation") & (F.col("operation") == "enqueue")), F.col("content"))
    none = F.array().cast("array<string>")
    each = F.concat(
        _kind("cwd", F.array("cwd")), _kind("permission_mode", F.array("permission_mode")), _kind("model", F.array(F.when(F.col("type") == "assistant", F.col("model")))),
        _kind("topic", F.coalesce(topics(said, patterns, ascii_borders), none)), _kind("slash", F.array(slash_command(said))), _kind("url", F.coalesce(url_hosts(said), none)),
    )
    return records.select("path", F.explode(each).alias("x")).groupBy("path", "x").agg(F.count("*").alias("n")).select("path", "x.kind", "x.key", "n")


def codex_sessions(threads: DataFrame, history: DataFrame, rollouts: DataFrame, cwd_pattern: str | None = None) -> DataFrame:
    """One row for each session of index, history or rollouts. Token totals are the greatest seen, as the log's are cumulative.

    cwd_pattern: only events in such folders count, and only sessions whose last folder is one stay (those without any don't)."""
    at = F.struct(*ORDER)
    past = history.where("session_id <> ''").groupBy("session_id").agg(F.count("*").alias("prompt_count"), F.min_by("text", at).alias("__text"))
    rows = rollouts.where("session_id is not null")
    started = rows.where("meta_id is not null").groupBy("session_id").agg(F.max_by(F.struct(F.try_to_timestamp("meta_timestamp").alias("t")), at).alias("s"), F.max_by("meta_cwd", F.when(F.col("meta_cwd").isNotNull(), at)).alias("cwd"))
    events = rows.where("meta_id is null")
    if cwd_pattern:
        events = events.where(F.coalesce("cwd", F.lit("")).contains(cwd_pattern))
    kind = lambda t, p=None: (F.col("type") == t) & (F.col("payload_type") == p)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    agent = kind("event_msg", "agent_message")
    seen = events.groupBy("session_id").agg(
        count(kind("event_msg", "user_message")).alias("user_messages"), count(kind("response_item", "message") & (F.col("role") == "assistant")).alias("assistant_messages"), count(agent & (F.col("phase") == "commentary")).alias("commentary"),
        count(agent & (F.col("phase") == "final_answer")).alias("final_answers"), count(kind("response_item", "function_call")).alias("tool_calls"),
        *(F.max(F.when(kind("event_msg", "token_count"), F.col(c)).otherwise(0)).alias(c) for c in ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens")),
    )
    out = threads.join(past, "session_id", "full_outer").join(started, "session_id", "full_outer").join(seen, "session_id", "full_outer")
    numbers = ["prompt_count", "user_messages", "assistant_messages", "commentary", "final_answers", "tool_calls", "input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens"]
    line = F.substring(F.element_at(F.split("__text", r"\r\n|[\n\r]"), 1), 1, 120)
    out = out.select("session_id", F.coalesce(F.nullif("thread_name", F.lit("")), line, F.lit("")).alias("thread_name"), "updated_at", F.col("s.t").alias("started_at"), F.coalesce("cwd", F.lit("")).alias("cwd"), *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers))
    return out.where(F.col("cwd").contains(cwd_pattern)) if cwd_pattern else out


def codex_counters(history: DataFrame, rollouts: DataFrame, patterns: Mapping[str, str] | None = None, ascii_borders: bool = False) -> DataFrame:
    """(session_id, kind, key, n): topics and URL hosts of prompts and messages, tools and models."""
    patterns, none = patterns or TOPICS_B, F.array().cast("array<string>")
    talk = lambda c: F.concat(_kind("topic", F.coalesce(topics(c, patterns, ascii_borders), none)), _kind("url", F.coalesce(url_hosts(c), none)))
    past = history.where("session_id <> ''").select("session_id", F.explode(talk(F.col("text"))).alias("x"))
    said = F.when((F.col("type") == "event_msg") & (F.col("payload_type") == "user_message"), F.col("message"))
    tool, model = F.when((F.col("type") == "response_item") & (F.col("payload_type") == "function_call"), F.col("name")), F.when(F.col("type") == "turn_context", F.col("model"))
    live = rollouts.where("session_id is not null and meta_id is null").select("session_id", F.explode(F.concat(talk(said), _kind("tool", F.array(tool)), _kind("model", F.array(model)))).alias("x"))
    return past.unionByName(live).groupBy("session_id", "x").agg(F.count("*").alias("n")).select("session_id", "x.kind", "x.key", "n")


def merged(counters: DataFrame, k: int | None = None) -> DataFrame:
    """(kind, key, n) over all sessions; k: only the most frequent of each kind, on ties the least key."""
    total = counters.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    if k is None:
        return total
    return total.withColumn("__r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))).where(F.col("__r") <= k).drop("__r")


def session_shape(sessions: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: n_sessions, and of each column the total, the exact median and the mean."""
    return sessions.agg(F.count("*").alias("n_sessions"), *(f(F.col(c)).alias(f"{n}_{c}") for c in columns for n, f in (("total", F.sum), ("median", F.median), ("mean", F.avg))))


def overview(sessions: DataFrame, place: str = "project", numbers: Sequence[str] = (), created: str = "created", modified: str = "modified") -> DataFrame:
    """One row: n_sessions, n_projects (distinct values of ``place``, empty ones too, null not), the earliest start, the latest change, and the totals of the numbers. Nulls of no session: null."""
    return sessions.agg(F.count("*").alias("n_sessions"), F.count_distinct(place).alias("n_projects"), F.min(created).alias("first_created"), F.max(modified).alias("last_modified"), *(F.sum(c).alias(f"total_{c}") for c in numbers))


def report(title: str, sessions: DataFrame, counters: DataFrame, numbers: Sequence[str], *, place: str = "project", created: str = "created", modified: str = "modified", k: int = 10) -> str:
    """Markdown: totals, dates, medians and means, then the k most frequent keys of each kind of counter. Only one row of numbers and k keys a kind come to the driver."""
    row = overview(sessions, place, numbers, created, modified).first()
    shape = session_shape(sessions, numbers).first()
    facts = {"Sessions": row["n_sessions"], "Projects": row["n_projects"], "From": row["first_created"], "To": row["last_modified"]}
    for c in numbers:
        facts[c] = f"{row[f'total_{c}'] or 0} in all, median {shape[f'median_{c}']}, mean {shape[f'mean_{c}']}"
    sections: dict[str, list[tuple[str, int]]] = {}
    for r in sorted(merged(counters, k).collect(), key=lambda r: (r.kind, -r.n, r.key)):
        sections.setdefault(r.kind, []).append((f"`{r.key}`", r.n))
    return markdown(title, facts, sections)


def in_order(sessions: DataFrame, *times: str) -> DataFrame:
    """Sessions by the first of the times that they have; those without come first."""
    return sessions.orderBy(F.coalesce(*times).asc_nulls_first())
