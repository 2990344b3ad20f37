"""Near-duplicate embeddings by iterative quantisation (ITQ) and multi-index Hamming tables.

Vectors are scaled to length 1, centred and projected on their ``bits`` principal directions; then a rotation is learned that brings the projections close to the corners of
the cube: codes are the signs, the rotation the orthogonal Procrustes solution, in turns, from sums over all rows. A code is cut into ``tables`` substrings, each with a
hash table. Two vectors are candidates if in some table their substrings differ in ``flips`` bits at most: so all pairs within a Hamming distance of
tables * (flips + 1) - 1 are found, by equi-joins (one side is entered with every such change). Candidates within ``radius`` are reranked with the original vectors:
a pair is a near-duplicate if its cosine is at least ``threshold``. Groups are the connected components.

Rows with equal vectors are one node of the search, so exact copies cost nothing. The more rows, the longer the substrings should be (about the logarithm of their number).

Cases: an empty table gives an empty result. Unusable vectors and the zero vector (see vectors.py) are in no group. Rows with equal id and vector are one row; rows with equal id and different vectors are different. The row
kept of a group is the one with the least id (null first), on ties the least vector hash. Columns besides id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, written
from .vectors import matrix, summed, vector_table

BITS, TABLES, FLIPS, RADIUS, THRESHOLD, ITERATIONS, SEED = 64, 4, 1, 16, 0.95, 10, 3


def learn(table: DataFrame, d: int, bits: int, iterations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the projection with the rotation (d x bits)."""
    n = table.count()
    moments = summed(table, d, d + d * d, lambda x: np.concatenate([x.sum(0), (x.T @ x).ravel()])) / max(n, 1)
    mean = moments[:d]
    _, vectors = np.linalg.eigh(moments[d:].reshape(d, d) - np.outer(mean, mean))
    w = vectors[:, ::-1][:, :bits]
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(w.shape[1], w.shape[1])))
    for _ in range(iterations):

        def each(x: np.ndarray, w=w, r=r) -> np.ndarray:
            v = (x - mean) @ w
            return np.where(v @ r > 0, 1.0, -1.0).T @ v

        a, _, b = np.linalg.svd(summed(table, d, r.size, each).reshape(r.shape))
        r = b.T @ a.T
    return mean, w @ r


def codes(table: DataFrame, d: int, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    """The table with each vector's code in a long."""
    shared = table.sparkSession.sparkContext.broadcast((mean, projection))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, p = shared.value
        for batch in batches:
            on = (matrix(batch.column(1), d).astype(np.float64) - m) @ p > 0
            code = (on.astype(np.uint64) << np.arange(p.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], names=["node", "vec", "code"])

    return table.select("node", "vec").mapInArrow(run, "node long, vec binary, code long")


def candidates(coded: DataFrame, bits: int, tables: int, flips: int, radius: int) -> DataFrame:
    """(a, b), a < b, each once."""
    edges = np.linspace(0, bits, tables + 1).astype(int)
    entry, probe = [], []
    for t in range(tables):
        width = int(edges[t + 1] - edges[t])
        part = F.shiftright("code", int(edges[t])).bitwiseAND(F.lit((1 << width) - 1)).cast("long")
        changes = [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(width), n)]
        entry.append(F.struct(F.lit(t).alias("t"), part.alias("s")))
        probe += [F.struct(F.lit(t).alias("t"), part.bitwiseXOR(F.lit(c).cast("long")).alias("s")) for c in changes]
    left = coded.select(F.col("node").alias("a"), F.col("code").alias("ca"), F.explode(F.array(*probe)).alias("at")).select("a", "ca", "at.*")
    right = coded.select(F.col("node").alias("b"), F.col("code").alias("cb"), F.explode(F.array(*entry)).alias("at")).select("b", "cb", "at.*")
    near = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= radius
    return left.join(right, ["t", "s"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def near_pairs(nodes: DataFrame, d: int, *, bits: int, tables: int, flips: int, radius: int, threshold: float, iterations: int, seed: int) -> DataFrame:
    """(a, b, cosine) of the near-duplicate pairs of distinct vectors (node, vec)."""
    bits = min(bits, d)
    mean, projection = learn(nodes, d, bits, iterations, seed)
    pairs = candidates(codes(nodes, d, mean, projection), bits, min(tables, bits), flips, radius)
    left, right = nodes.select(F.col("node").alias("a"), F.col("vec").alias("va")), nodes.select(F.col("node").alias("b"), F.col("vec").alias("vb"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = np.einsum("ij,ij->i", matrix(batch.column(2), d).astype(np.float64), matrix(batch.column(3), d).astype(np.float64))
            ok = pa.array(cosine >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(cosine).filter(ok)], names=["a", "b", "cosine"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(rerank, "a long, b long, cosine double")


def near_duplicates(
    rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", *, bits: int = BITS, tables: int = TABLES, flips: int = FLIPS, radius: int = RADIUS,
    threshold: float = THRESHOLD, iterations: int = ITERATIONS, seed: int = SEED,
) -> DataFrame:
    """(vec_id, group_id, group_size, n_links, keep) for every row that is in a group of two or more; n_links: how many other distinct vectors, of the candidates, are near-duplicates of its own."""
    kind = rows.schema[vec_id].dataType
    if bits > 64:
        raise ValueError("codes have 64 bits at most")
    table, d = vector_table(rows, vec_id, embedding, unit=True)
    if not d:
        return rows.sparkSession.createDataFrame([], T.StructType([T.StructField("vec_id", kind), T.StructField("group_id", kind), T.StructField("group_size", T.LongType()), T.StructField("n_links", T.LongType()), T.StructField("keep", T.BooleanType())]))
    names = table.select("id", F.xxhash64("vec").alias("node")).distinct()
    nodes = written(table.groupBy(F.xxhash64("vec").alias("node")).agg(F.first("vec").alias("vec")), "nodes")
    pairs = near_pairs(nodes, d, bits=bits, tables=tables, flips=flips, radius=radius, threshold=threshold, iterations=iterations, seed=seed)
    pairs = written(pairs.select("a", "b"), "pairs")
    links = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    grouped = names.join(connected_components(pairs).join(links, "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = grouped.groupBy("root").agg(F.min(F.struct("id", "node")).alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    return grouped.join(first, "root").select(F.col("id").alias("vec_id"), F.col("first.id").alias("group_id"), "group_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("node") == F.col("first.node"))).alias("keep"))
