"""MinHash near-duplicate removal with an LSH forest.

Every document gets ``perms`` minimum hashes of its two-word shingles (words in lower case, without punctuation). The forest has
``trees`` sorted orders of the distinct signatures; the t-th compares the values from position t * perms // trees on, cyclically.
In each order a document's candidates are
  - all documents of its region: those that share its first ``depths[i]`` values, with the least i whose region has at most
    ``region`` documents (the depth adapts to how crowded the region is), and
  - the neighbour before it, with which it shares the longest prefix, if that has ``depths[0]`` values at least.
So a crowded region is split further, never cut off, and a chain of longest-prefix neighbours runs through all of it. Documents with
equal signatures are one node of the forest. A candidate pair is a near-duplicate if its estimated Jaccard
similarity is at least ``threshold``: the share of all ``perms`` values whose low bytes agree, less what agrees by chance; groups are the
connected components.

Cases: an empty table gives an empty result. Texts are read whole, however long. A document without words (null, empty or punctuation only) is in no group and is kept. Rows with equal id and text are one
document. Rows with equal id and different texts are different documents. Null ids are allowed. The document kept of each group is the one
with the least id (null counts as the least), on ties the least text hash. Columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import connected_components, doc_key, free_name, utf8, written
from .words import mix, word_hashes

PERMS, TREES, DEPTHS, REGION, THRESHOLD, SHINGLE, SEED = 128, 20, (3, 4, 6, 8, 12, 24, 48), 24, 0.5, 2, 7


def _coefficients(perms: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(1, 2**63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, perms, dtype=np.uint64)


def signatures(column, perms: int = PERMS, shingle: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """uint32 signatures (one row for each text that has a word), and which texts those are. Shorter texts have one shingle of all their words."""
    words, counts = word_hashes(column)
    have = counts > 0
    counts = counts[have]
    if not len(counts):
        return np.zeros((0, perms), np.uint32), have
    size = np.minimum(counts, shingle)
    ends = np.cumsum(counts)
    h = words.copy()
    for k in range(1, shingle):
        h[:-k] = mix(h[:-k] + words[k:] * np.uint64(2 * k + 1))
    last = np.ones(len(words), bool)  # the first words of whole shingles
    for k in range(1, shingle):
        at = ends - k
        last[at[counts > k]] = False
    for i in np.flatnonzero(size < shingle):
        own = words[ends[i] - counts[i] : ends[i]]
        h[ends[i] - counts[i]] = mix(own[:1] + np.uint64(len(own)))[0]
        last[ends[i] - counts[i] + 1 : ends[i]] = False
    h = h[last]
    n = np.maximum(counts - shingle + 1, 1)
    stop = np.cumsum(n)
    a, b = _coefficients(perms, seed)
    out = np.empty((len(n), perms), np.uint32)
    i = 0
    while i < len(n):  # blocks of whole texts that stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(stop, stop[i] - n[i] + 65536, "right")))
        part = h[stop[i] - n[i] : stop[j - 1]]
        starts = stop[i:j] - n[i:j] - (stop[i] - n[i])
        buffer = np.empty_like(part)
        for k in range(perms):
            np.multiply(part, a[k], out=buffer)
            np.add(buffer, b[k], out=buffer)
            out[i:j, k] = np.minimum.reduceat(buffer, starts) >> np.uint64(32)
        i = j
    return out, have


def _packed(rows: np.ndarray) -> pa.Array:
    offs = pa.array((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offs, pa.py_buffer(np.ascontiguousarray(rows))])


def signature_table(docs: DataFrame, doc_id: str, text: str, perms: int, shingle: int, seed: int) -> DataFrame:
    """(id, key, sig, sketch, sig_hash) of all documents that have words; one row for each row of docs."""
    id_type = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("id"), doc_key(F.col(doc_id), F.col(text)).alias("key"), F.lower(F.col(text)).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, have = signatures(batch.column(2), perms, shingle, seed)
            keep = pa.array(have)
            mixed = np.zeros(len(sigs), np.uint64)
            for k in range(perms):
                mixed = mix(mixed * np.uint64(3) + sigs[:, k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), _packed(sigs.astype("<u4").view(np.uint8)), _packed(sigs.astype(np.uint8)), pa.array(mixed.view(np.int64))],
                names=["id", "key", "sig", "sketch", "sig_hash"],
            )

    schema = T.StructType([T.StructField("id", id_type), T.StructField("key", T.LongType()), T.StructField("sig", T.BinaryType()), T.StructField("sketch", T.BinaryType()), T.StructField("sig_hash", T.LongType())])
    return rows.mapInArrow(run, schema)


def _prefixes(sigs: DataFrame, perms: int, trees: int, depths: tuple[int, ...]) -> DataFrame:
    """(node, p0 long, p1 int, ...): hashes of the first depths[i] values in each tree's order; p0 tells the trees apart."""
    names = ["node", *(f"p{i}" for i in range(len(depths)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            s = utf8(batch.column(1))[0].view("<u4").reshape(n, perms).T.astype(np.uint64)
            for t in range(trees):
                order = (np.arange(perms) + t * perms // trees) % perms
                h, cols, done = np.full(n, t, np.uint64), [], 0
                for d in depths:
                    for k in range(done, d):
                        h = mix(h * np.uint64(5) + s[order[k]])
                    done = d
                    cols.append(pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32) if cols else h.view(np.int64).copy()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return sigs.select("sig_hash", "sig").mapInArrow(run, "node long, p0 long, " + ", ".join(f"p{i} int" for i in range(1, len(depths))))


def forest_candidates(sigs: DataFrame, perms: int = PERMS, trees: int = TREES, depths: tuple[int, ...] = DEPTHS, region: int = REGION) -> DataFrame:
    """Candidate pairs (a, b), a < b, each once, of the distinct signatures (sig_hash, sig). One shuffle and one sort serve all trees and depths."""
    depths = tuple(d for d in depths if d < perms) + (perms,)
    p = [f"p{i}" for i in range(len(depths))]
    near = Window.partitionBy("p0").orderBy(*p[1:], "node")
    x = _prefixes(sigs, perms, trees, depths).withColumn("n0", F.count("*").over(Window.partitionBy("p0"))).where("n0 > 1").withColumn("before", F.lag("node").over(near))
    level = F.when(F.col("n0") <= region, 0)
    for i in range(1, len(p)):
        x = x.withColumn(f"n{i}", F.count("*").over(Window.partitionBy(*p[: i + 1])))
        level = level.when(F.col(f"n{i}") <= region, i)
    x = x.withColumn("level", F.coalesce(level, F.lit(len(p))))
    at = F.lit(0)
    for i in range(1, len(p)):
        at = F.when(F.col("level") == i, F.col(p[i])).otherwise(at)
    pair = "array<struct<a:bigint,b:bigint>>"
    # areas are groups of the partitioning that is there already: no more shuffles
    found = x.select("p0", "level", at.alias("at"), "node", "before").groupBy("p0", "level", "at").agg(F.collect_list("node").alias("nodes"), F.collect_list(F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("a"), F.col("node").alias("b")))).alias("chain"))
    inside = F.when(F.size("nodes") > 1, F.flatten(F.transform("nodes", lambda u: F.transform(F.filter("nodes", lambda v: v > u), lambda v: F.struct(u.alias("a"), v.alias("b")))))).otherwise(F.array().cast(pair))
    return found.select(F.explode(F.concat(inside, "chain")).alias("e")).select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct()


def verified(candidates: DataFrame, sigs: DataFrame, perms: int, threshold: float) -> DataFrame:
    """(a, b, share): the pairs whose estimated similarity is ``threshold`` at least. Only a byte of each value is sent."""
    left = sigs.select(F.col("sig_hash").alias("a"), F.col("sketch").alias("sa"))
    right = sigs.select(F.col("sig_hash").alias("b"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (utf8(batch.column(k))[0].reshape(-1, perms) for k in (2, 3))
            share = ((x == y).mean(1) - 1 / 256) / (1 - 1 / 256)
            ok = pa.array(share >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(share).filter(ok)], names=["a", "b", "share"])

    return candidates.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, share double")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, perms: int = PERMS, trees: int = TREES, depths: tuple[int, ...] = DEPTHS,
    region: int = REGION, threshold: float = THRESHOLD, shingle: int = SHINGLE, seed: int = SEED,
) -> DataFrame:
    """(doc_id, key, group_id, group_size, n_links, keep) for every document that is in a group of two or more; the others are not listed.

    n_links: how many other signatures, of the candidates that were compared, are near-duplicates of the document's own; copies with equal signatures are told by the group. group_id is the id of the group's kept document; key is xxhash64(id, text), which tells apart rows with the same id.
    """
    table = written(signature_table(docs, doc_id, text, perms, shingle, seed), "signatures")
    sigs = written(table.groupBy("sig_hash").agg(F.first("sig").alias("sig"), F.first("sketch").alias("sketch")), "forest")  # equal hash, equal signature: any will do
    pairs = written(verified(forest_candidates(sigs, perms, trees, depths, region), sigs, perms, threshold).select("a", "b"), "pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("sig_hash")).groupBy("sig_hash").agg(F.count("*").alias("n_links"))
    roots = connected_components(pairs).withColumnsRenamed({"node": "sig_hash"}).join(links, "sig_hash")
    names = table.select("id", "key", "sig_hash").distinct()
    grouped = names.join(roots, "sig_hash", "left").select("id", "key", F.coalesce("root", "sig_hash").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    first = grouped.groupBy("root").agg(F.min(F.struct("id", "key")).alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    return grouped.join(first, "root").select(
        F.col("id").alias("doc_id"), "key", F.col("first.id").alias("group_id"), "group_size", "n_links", (F.col("key") == F.col("first.key")).alias("keep")
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with the same columns: one row of each group, and all rows in no group (of equal id and text, one). Rows without words stay."""
    own = free_name(docs, "__key")
    gone = near_duplicates(docs, doc_id, text, **how).where("not keep").select(F.col("key").alias(own))
    rest = docs.withColumn(own, doc_key(F.col(doc_id), F.col(text))).join(gone, own, "left_anti")
    return rest.dropDuplicates([own]).drop(own)
