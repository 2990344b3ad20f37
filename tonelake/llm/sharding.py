"""Shards of about equal size in key order, from sampled splitters.

1. A record is drawn with probability min(1, oversample * size / target): a size-weighted sample, decided by a hash of its key and id.
2. The sample is sorted by (key, id); where the running weight passes a multiple of ``target_bytes``, there is a splitter.
3. Every record goes to the range between two splitters that holds its (key, id), and the ranges' true sizes are added up over all records.
4. Ranges over ``most`` * target are overfull: they are sampled again, at a higher rate, and get splitters of their own, until none is left that can be
   divided further (one record, or rows with the same key and id, never are). The rate grows to 1, so this ends.

Shards are numbered in order of (key, id); ids that aren't whole numbers are ordered by their hash. The size of a record is the bytes of its text, however long.

Cases: null keys come first, then null ids within a key. Null or empty text has size 0 and is a record like any other. Rows with equal key and id stay together. An empty table
gives no shards. The shard column replaces one of that name; other columns are kept as they are.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

TARGET_BYTES, OVERSAMPLE, MOST, SEED = 32 << 20, 32, 1.25, 5

Splitter = tuple[str, int]


def _order(docs: DataFrame, key: str, doc_id: str) -> tuple[Column, Column]:
    """The key as a string that sorts like it and has null first, and the id as a number."""
    kind, c = docs.schema[key].dataType, F.col(f"`{key}`")
    if isinstance(kind, T.IntegralType):
        c = F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    elif isinstance(kind, (T.TimestampType, T.DateType, T.StringType)):
        c = c.cast("string")
    else:
        raise TypeError("a key is a string, a whole number, a date or a time")
    own = F.col(f"`{doc_id}`")
    number = own.cast("long") if isinstance(docs.schema[doc_id].dataType, T.IntegralType) else F.xxhash64(own)
    return F.coalesce(F.concat(F.lit("\x01"), c), F.lit("")), F.coalesce(number, F.lit(-(2**63)))


def _range_of(splitters: list[Splitter], session) -> object:
    """An Arrow UDF from (key, id) to the number of splitters that are not greater. Splitters are sent to every worker: a key and a number for each ``target_bytes`` of the input."""
    shared = session.sparkContext.broadcast(([s[0] for s in splitters], np.array([s[1] for s in splitters], np.int64)))

    @F.arrow_udf("int")
    def place(key: pa.Array, number: pa.Array) -> pa.Array:
        keys, ids = shared.value
        coded = key.dictionary_encode()
        which, n = coded.indices.to_numpy(), number.to_numpy()
        out = np.zeros(len(n), np.int32)
        order = np.argsort(which, kind="stable")
        bounds = np.searchsorted(which[order], np.arange(len(coded.dictionary) + 1))
        for i, k in enumerate(coded.dictionary.to_pylist()):
            rows = order[bounds[i] : bounds[i + 1]]
            lo, hi = bisect.bisect_left(keys, k), bisect.bisect_right(keys, k)
            out[rows] = lo + np.searchsorted(ids[lo:hi], n[rows], "right") if hi > lo else lo
        return pa.array(out)

    return place


def _drawn(sizes: DataFrame, step: float, seed: int) -> DataFrame:
    """A size-weighted sample with weights: a record of at least ``step`` is always drawn and weighs its size, a smaller one weighs ``step``."""
    u = (F.pmod(F.xxhash64("key", "number", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return sizes.where(u < F.col("size") / F.lit(step)).withColumn("w", F.greatest(F.col("size").cast("double"), F.lit(step)))


def _cuts(at: DataFrame) -> list[Splitter]:
    """Splitters are records where the part changes; a record that is larger than a shard begins one, and so does what follows it."""
    return sorted({(r.key, r.number) for r in at.where("(part > last or large) and last is not null").select("key", "number").collect()})


def _first_splitters(sizes: DataFrame, target: int, oversample: float, seed: int) -> list[Splitter]:
    """Weighted quantiles of a sample of all records, at every ``target`` of weight. The sample has about ``oversample`` rows for each splitter; it is sorted by range
    partitions, each of which starts at the weight of those before. Only the partitions' sums and the splitters come to the driver."""
    parts = sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")
    drawn = _drawn(sizes, target / oversample, seed).repartitionByRange(int(parts), "key", "number").withColumn("range", F.spark_partition_id())
    drawn = written(drawn, "sample")
    each = sorted(drawn.groupBy("range").agg(F.sum("w").alias("w"), F.max_by("size", F.struct("key", "number")).alias("size")).collect())
    before, last, large = 0.0, None, False
    rows = []
    for r in each:
        rows.append((r["range"], before, last, large))
        before += r.w
        last, large = int(before // target), r["size"] >= target
    start = F.broadcast(drawn.sparkSession.createDataFrame(rows, "range int, before double, part_before long, large_before boolean"))  # a row for each shuffle partition
    window = Window.partitionBy("range").orderBy("key", "number")
    run = F.sum("w").over(window.rowsBetween(Window.unboundedPreceding, 0))
    at = drawn.join(start, "range").withColumn("part", F.floor((F.col("before") + run) / float(target)))
    return _cuts(at.withColumns({"last": F.coalesce(F.lag("part").over(window), "part_before"), "large": F.coalesce(F.lag("size").over(window) >= target, "large_before")}))


def _more_splitters(sizes: DataFrame, target: int, rate: float, seed: int) -> list[Splitter]:
    """The same within each overfull group of sizes (group, key, number, size), whose sample one task sorts."""
    window = Window.partitionBy("group").orderBy("key", "number")
    run = F.sum("w").over(window.rowsBetween(Window.unboundedPreceding, 0))
    at = _drawn(sizes, target / rate, seed).withColumn("part", F.floor(run / float(target)))
    return _cuts(at.withColumns({"last": F.lag("part").over(window), "large": F.lag("size").over(window) >= target}))


def splitters(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str = "source", *, target_bytes: int = TARGET_BYTES, oversample: int = OVERSAMPLE, most: float = MOST, seed: int = SEED) -> list[Splitter]:
    """The final splitters, in order."""
    if target_bytes < 1 or oversample < 1 or most < 1:
        raise ValueError("target_bytes, oversample and most are 1 at least")
    k, n = _order(docs, key, doc_id)
    rows = docs.select(k.alias("key"), n.alias("number"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("size"))
    sizes = written(rows.groupBy("key", "number").agg(F.sum("size").alias("size")), "sizes")  # rows that stay together are one record
    found = _first_splitters(sizes, target_bytes, oversample, seed)
    rate, turn = float(oversample), 0
    while True:
        placed = sizes.withColumn("group", _range_of(found, docs.sparkSession)("key", "number"))
        total = placed.groupBy("group").agg(F.sum("size").alias("all"), F.count_if(F.col("size") > 0).alias("records"))
        over = written(total.where((F.col("all") > most * target_bytes) & (F.col("records") > 1)).select("group", "all"), "overfull")
        if over.isEmpty():
            return found
        # at rate target_bytes every record is drawn, and then each overfull range gets a splitter at least: the loop ends
        rate, turn = min(rate * 4, float(target_bytes)), turn + 1
        # an equal cut of each overfull range, not whole targets and a small rest
        share = F.col("all") / F.ceil(F.col("all") / target_bytes)
        scaled = placed.join(over, "group").withColumn("size", F.ceil(F.col("size") * float(target_bytes) / share).cast("long"))
        found = sorted({*found, *_more_splitters(scaled, target_bytes, rate, seed + turn)})


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str = "source", column: str = "shard", **how) -> DataFrame:
    """docs with a column shard, each shard in a partition of its own, ready to be written as a file."""
    found = splitters(docs, doc_id, text, key, **how)
    k, n = _order(docs, key, doc_id)
    placed = docs.withColumn(column, _range_of(found, docs.sparkSession)(k, n))
    return placed.repartitionById(len(found) + 1, F.col(column))
