"""Session logs as rows: JSON lines of two assistants' logs, their indexes, and mining input.

``lines`` keeps the order of a file's lines without reading it as a whole: (path, block, at) sorts them, block being where a split of the file starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = ["path", "block", "at"]
SUBAGENTS = "/subagents/"
_FIRST_IN_FILE = ["block", "at"]


def lines(spark: SparkSession, root: str, *, path_pattern: str | None = None, glob: str = "*.jsonl") -> DataFrame:
    """(path, block, at, line) of all non-blank lines below root, without sub-agents' files; path_pattern: a part of the path. Both are pruned before files are opened."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root)
    path = F.col("_metadata.file_path")
    df = df.where(~path.contains(SUBAGENTS))
    if path_pattern:
        df = df.where(path.contains(path_pattern))
    # filters on the path stand below the line number, else they would not reach the list of files
    df = df.select(path.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return df.where(F.trim("line") != "")


def parsed(rows: DataFrame, strict: bool = False) -> DataFrame:
    """rows with ``v``, the line as a VARIANT. Lines that aren't JSON objects go; with strict, malformed ones are an error."""
    v = (F.parse_json if strict else F.try_parse_json)(F.col("line"))
    return rows.withColumn("v", v).where("v is not null and startswith(schema_of_variant(v), 'OBJECT')").drop("line")


def part(path: str, kind: str = "string", of: str = "v") -> Column:
    """A part of a VARIANT column, null where it is missing or of another kind."""
    return F.try_variant_get(F.col(of), path, kind)


def text_part(path: str, of: str = "v") -> Column:
    """A part that is a string in the JSON; null for numbers, lists and objects."""
    return F.expr(f"CASE WHEN schema_of_variant(try_variant_get({of}, '{path}', 'variant')) = 'STRING' THEN try_variant_get({of}, '{path}', 'string') END")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    """The name of the folder that a file is in."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def claude_records(rows: DataFrame) -> DataFrame:
    """Typed records of parsed rows. content: a user's or queued text, null if it isn't a string; tool_uses: of the assistant's content list."""
    tools = F.size(F.filter(part("$.message.content", "array<variant>"), lambda x: F.try_variant_get(x, "$.type", "string") == "tool_use"))
    number = lambda p: F.coalesce(part(p, "bigint"), F.lit(0))
    return rows.select(
        *ORDER, parent(F.col("path")).alias("project"), F.coalesce(part("$.sessionId"), stem(F.col("path"))).alias("session_id"), stem(F.col("path")).alias("file_id"), part("$.type").alias("type"), part("$.subtype").alias("subtype"), part("$.operation").alias("operation"),
        F.coalesce(part("$.isMeta", "boolean"), F.lit(False)).alias("is_meta"), part("$.message.role").alias("role"), F.coalesce(F.when(part("$.type") == "queue-operation", text_part("$.content")), F.when(part("$.type") == "user", text_part("$.message.content"))).alias("content"),
        part("$.timestamp").alias("timestamp"), F.coalesce(part("$.cwd"), F.lit("")).alias("cwd"), part("$.permissionMode").alias("permission_mode"), part("$.message.model").alias("model"), F.coalesce(F.greatest(tools, F.lit(0)), F.lit(0)).alias("tool_uses"),
        number("$.durationMs").alias("duration_ms"), *(number(f"$.message.usage.{j}").alias(c) for j, c in (("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("cache_read_input_tokens", "cache_read_tokens"), ("cache_creation_input_tokens", "cache_creation_tokens"))),
    )


def claude_index(spark: SparkSession, root: str, path_pattern: str | None = None) -> DataFrame:
    """(folder, session_id, full_path, created, modified, summary, first_prompt): the entries of all sessions-index.json files."""
    entry = "struct<sessionId:string,fullPath:string,created:string,modified:string,summary:string,firstPrompt:string,messageCount:bigint>"
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "sessions-index.json").schema(f"entries array<{entry}>").option("multiLine", True).json(root).select(F.col("_metadata.file_path").alias("path"), "entries")
    if path_pattern:
        df = df.where(F.col("path").contains(path_pattern))
    e = df.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.explode("entries").alias("e"))
    return e.select("folder", F.col("e.sessionId").alias("session_id"), F.col("e.fullPath").alias("full_path"), F.to_timestamp("e.created").alias("created"), F.to_timestamp("e.modified").alias("modified"), F.coalesce("e.summary", F.lit("")).alias("summary"), F.coalesce("e.firstPrompt", F.lit("")).alias("first_prompt"))


def resolve_sessions(index: DataFrame, listing: DataFrame) -> DataFrame:
    """listing's files with their index entries: an entry's own path if it is there, else <folder>/<session>.jsonl; and files of indexed folders that no entry names.

    listing: (path). Entries whose file isn't there, and files of folders without an index, don't appear."""
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    files = listing.select(F.col("path"), plain(F.col("path")).alias("own")).distinct()
    entries = index.withColumn("__folder", plain(F.col("folder"))).withColumn("__a", plain(F.col("full_path"))).withColumn("__b", F.concat("__folder", F.lit("/"), "session_id", F.lit(".jsonl")))
    a, b = (files.select(F.col("path").alias(f"p{x}"), F.col("own").alias(f"o{x}")) for x in "ab")
    named = entries.join(a, F.col("__a") == F.col("oa"), "left").join(b, F.col("__b") == F.col("ob"), "left").withColumn("path", F.coalesce("pa", "pb")).where("path is not null")
    columns = ["path", "session_id", "created", "modified", "summary", "first_prompt"]
    rest = files.withColumn("__folder", F.regexp_replace("own", "/[^/]*$", "")).join(entries.select("__folder").distinct(), "__folder", "left_semi").join(named.select("path"), "path", "left_anti")
    return named.select(*columns).unionByName(rest.select("path", stem(F.col("path")).alias("session_id")), allowMissingColumns=True)


def codex_rollouts(rows: DataFrame) -> DataFrame:
    """Typed records of parsed rollout rows, each with the session and folder of the last session_meta before it in its file (null if there was none)."""
    before = Window.partitionBy("path").orderBy(*_FIRST_IN_FILE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    meta = part("$.type") == "session_meta"
    name = F.nullif(part("$.payload.id"), F.lit(""))
    number = lambda p: F.coalesce(part(f"$.payload.info.total_token_usage.{p}", "bigint"), F.lit(0)).alias(p)
    return rows.select(
        *ORDER, part("$.type").alias("type"), part("$.payload.type").alias("payload_type"), F.last(F.when(meta, name), ignorenulls=True).over(before).alias("session_id"),
        F.last(F.when(meta, part("$.payload.cwd")), ignorenulls=True).over(before).alias("cwd"), part("$.timestamp").alias("timestamp"), part("$.payload.timestamp").alias("meta_timestamp"), F.when(meta, part("$.payload.cwd")).alias("meta_cwd"), F.when(meta, name).alias("meta_id"),
        F.coalesce(part("$.payload.message"), F.lit("")).alias("message"), part("$.payload.phase").alias("phase"), part("$.payload.role").alias("role"), part("$.payload.name").alias("name"), part("$.payload.model").alias("model"),
        *map(number, ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_output_tokens")),
    )


def codex_history(rows: DataFrame) -> DataFrame:
    """(path, block, at, session_id, ts, text) of parsed history rows."""
    return rows.select(*ORDER, F.coalesce(part("$.session_id"), F.lit("")).alias("session_id"), F.coalesce(part("$.ts"), F.lit("")).alias("ts"), F.coalesce(part("$.text"), F.lit("")).alias("text"))


def codex_threads(rows: DataFrame) -> DataFrame:
    """(session_id, thread_name, updated_at) of parsed index rows; the last line of a session counts."""
    own = rows.select(*ORDER, part("$.id").alias("session_id"), F.coalesce(part("$.thread_name"), F.lit("")).alias("thread_name"), F.to_timestamp(part("$.updated_at")).alias("updated_at"))
    return own.where("session_id is not null").groupBy("session_id").agg(F.max_by(F.struct("thread_name", "updated_at"), F.struct(*ORDER)).alias("x")).select("session_id", "x.*")


def session_folders(rollouts: DataFrame) -> DataFrame:
    """(session_id, cwd): of each file the first session_meta, of several files the last."""
    first = rollouts.where("meta_id is not null").groupBy("path").agg(F.min_by(F.struct(F.col("meta_id").alias("session_id"), F.coalesce("meta_cwd", F.lit("")).alias("cwd")), F.struct(*_FIRST_IN_FILE)).alias("x"))
    return first.groupBy("x.session_id").agg(F.max_by("x.cwd", "path").alias("cwd"))
