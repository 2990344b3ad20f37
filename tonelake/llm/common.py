"""What several corpus operators share: written intermediate tables, connected components, Arrow helpers."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where a local session names no folder; a cluster names its shared folder in spark.checkpoint.dir.
_OWN_DIR = "/tmp/tonelake-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as the session has it; where it is unset, one of this machine if the master is local, else an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(_OWN_DIR)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_written: dict[str, list[str]] = {}
_bucketed: set[str] = set()  # the names of those that are in the catalog


def written(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: it cuts lineage and survives the loss of executors.

    by: a column by whose hash the rows are kept in buckets, as many as a shuffle has partitions, so that grouping by it doesn't shuffle the table. Such a table is in the
    session's catalog until it is dropped."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tonelake-{what}-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path)
    else:
        _bucketed.add(_name(path))
        df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(_in_catalog(path))
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path) if by is None else spark.table(_in_catalog(path))


def _in_catalog(path: str) -> str:
    return f"spark_catalog.default.{_name(path).replace('-', '_')}"


def drop_written(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes the tables that ``written`` made for this application (or those given); results that read them must be stored first."""
    own = _written.get(spark.sparkContext.applicationId, [])
    for path in filter(None, list(own if paths is None else paths)):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if _name(path) in _bucketed:
            spark.sql(f"DROP TABLE IF EXISTS {_in_catalog(path)}")
            _bucketed.remove(_name(path))
        own[:] = [p for p in own if _name(p) != _name(path)]


def _name(path: str) -> str:
    """A table's own name: the same path may be written with and without its scheme."""
    return path.rstrip("/").rsplit("/", 1)[-1]


def tables(spark: SparkSession) -> list[str]:
    """The paths of the tables that ``written`` made for this application and that are still there, the latest last."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def path_of(df: DataFrame) -> str:
    """The folder of a table that ``written`` returned."""
    first = df.inputFiles()
    return first[0].rsplit("/", 1)[0] if first else ""


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge: root is the least node of its component.

    Large-star then small-star rounds, each linking every node straight to the least neighbour known, until no edge changes; the number
    of rounds grows with the logarithm of the longest path. A hub's neighbours never pass through one task's memory: both stars are a
    partial minimum and a join. Each round's edges are a written table; the one before is deleted once it is replaced.
    Edges with a null end and loops give no component.
    """
    spark = edges.sparkSession
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    stamp = lambda e: e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = stamp(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(small, "edges")
        count = stamp(after)
        before, now = now, after
        drop_written(spark, [path_of(before)])
        if count == seen:
            break
        seen = count
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings, and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lists(values: np.ndarray, sizes: np.ndarray, mask: pa.Array | None = None) -> pa.Array:
    """A list array of the flat values, cut by sizes; null where mask is true."""
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    if at[-1] >= 2**31:
        raise ValueError("more than 2**31 values in one Arrow batch: lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values), mask=mask)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def doc_key(doc_id: Column, text: Column) -> Column:
    """64 bits for a document row; rows with the same id and text share it."""
    return F.xxhash64(doc_id, text)
