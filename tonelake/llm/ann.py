"""Approximate nearest neighbours with an inverted multi-index.

Each vector's two halves are quantised separately (``centroids`` k-means centroids each, trained by Lloyd steps over all rows), so a vector falls into one of
centroids ** 2 cells. A query visits cells in order of the summed distances of its halves to the cell's two centroids, taken from a heap, until the
visited cells hold ``share`` of all entries; the entries of just these cells are reranked with their own vectors. Every row is an entry; queries are the rows whose id
``queries`` accepts, by default all.

Entries are laid out by cell and cut into shards of about ``shard_rows``, large cells too; a query goes, with the set of cells that it visits, to the shards that hold any of them, and
each shard reranks a block of at most about ``query_rows`` queries at a time; the shards' best are merged. How large ``share`` must be depends on the vectors: see the README for measurements.

Cases: unusable vectors (see vectors.py) are neither queries nor entries. A row is not its own neighbour; another row with the same id isn't either, one with the same vector is.
A null id counts as an id. Rows with one id and different vectors are queries of their own, each with its own neighbours.
A null id is a query if ``queries`` is not given. Columns besides id and vector are ignored, whatever their names. Ties go to the lesser id. With k or fewer other rows a query has fewer neighbours. Repeated rows (equal id and vector) are one row. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8
from .vectors import matrix, summed, vector_table

K, CENTROIDS, SHARE, ITERATIONS, SHARD_ROWS, QUERY_ROWS = 10, 32, 0.5, 8, 16384, 65536


def _d2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def train(table: DataFrame, d: int, centroids: int, iterations: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of the first and the second half. Lloyd's steps start from the rows with the least hashes and cover all rows."""
    h = d // 2
    first = table.select("vec").distinct().orderBy(F.xxhash64("vec")).limit(centroids).collect()
    start = np.array([np.frombuffer(r.vec, "<f4") for r in first], np.float64)
    books = [np.unique(start[:, :h], axis=0), np.unique(start[:, h:], axis=0)]
    for _ in range(iterations):
        sizes = [b.shape[0] * (b.shape[1] + 1) for b in books]

        def each(x: np.ndarray, books=books) -> np.ndarray:
            out = []
            for part, b in ((x[:, :h], books[0]), (x[:, h:], books[1])):
                near = _d2(part, b).argmin(1)
                one = np.zeros((len(b), len(x)))
                one[near, np.arange(len(x))] = 1
                out.append(np.hstack([one @ part, one.sum(1)[:, None]]).ravel())
            return np.concatenate(out)

        total = summed(table, d, sum(sizes), each)
        for i, part in enumerate(np.split(total, [sizes[0]])):
            m = part.reshape(len(books[i]), -1)
            some = m[:, -1] > 0
            books[i] = np.where(some[:, None], m[:, :-1] / np.maximum(m[:, -1:], 1), books[i])
    return books[0], books[1]


def traverse(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, need: int) -> list[int]:
    """Cells i * len(d2) + j in order of d1[i] + d2[j], until they hold ``need`` entries. counts: each cell's entries."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    a, b, width = d1[o1].tolist(), d2[o2].tolist(), len(d2)
    held = counts.tolist() if isinstance(counts, np.ndarray) else counts
    heap, out, n1, n2 = [(a[0] + b[0], 0, 0)], [], len(a), len(b)
    while heap and need > 0:
        _, i, j = heap[0]
        cell = o1[i] * width + o2[j]
        n = held[cell]
        if n:
            out.append(cell)
            need -= n
        if j + 1 < n2:
            heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < n1:
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


def neighbours(
    rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", *, queries: Callable[[Column], Column] | None = None, k: int = K, centroids: int = CENTROIDS, share: float = SHARE,
    iterations: int = ITERATIONS, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(vec_id, rank, neighbour_id, distance): the k nearest other rows found for every usable row that is a query, by Euclidean distance."""
    spark = rows.sparkSession
    kind = rows.schema[vec_id].dataType
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("other", kind), T.StructField("other_row", T.LongType()), T.StructField("distance", T.DoubleType())])
    table, d = vector_table(rows.dropDuplicates([vec_id, embedding]).select(vec_id, embedding), vec_id, embedding, unit=False)
    if d < 2:
        if d == 1:
            raise ValueError("a vector needs two halves")
        return spark.createDataFrame([], T.StructType([T.StructField("vec_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("neighbour_id", kind), T.StructField("distance", T.DoubleType())]))
    one, two = train(table, d, centroids, iterations)
    h, cells = d // 2, len(one) * len(two)
    books = spark.sparkContext.broadcast((one, two))  # fixed size

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b1, b2 = books.value
        for batch in batches:
            x = matrix(batch.column(1), d).astype(np.float64)
            cell = _d2(x[:, :h], b1).argmin(1) * len(b2) + _d2(x[:, h:], b2).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["id", "vec", "cell"])

    coded = table.mapInArrow(quantise, T.StructType([*table.schema.fields, T.StructField("cell", T.IntegerType())]))
    counts = np.zeros(cells, np.int64)
    for r in coded.groupBy("cell").count().collect():  # centroids ** 2 at most
        counts[r.cell] = r["count"]
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    first, last = begin // shard_rows, np.maximum(begin + counts - 1, begin) // shard_rows  # the shards of each cell
    asking = table.where(queries(F.col("id"))) if queries else table
    blocks, need = max(1, -(-asking.count() // query_rows)), max(k + 1, int(np.ceil(share * total)))
    plan = spark.sparkContext.broadcast((counts.tolist(), first, last))  # of centroids ** 2 cells

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (b1, b2), (held, lo, hi) = books.value, plan.value
        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            x = matrix(batch.column(1), d).astype(np.float64)
            d1, d2 = _d2(x[:, :h], b1), _d2(x[:, h:], b2)
            seen = np.zeros((len(x), cells), bool)
            for i in range(len(x)):
                seen[i, traverse(d1[i], d2[i], held, need)] = True
            at, to = [], []
            for i in range(len(x)):
                cells_of = np.flatnonzero(seen[i])
                size = hi[cells_of] - lo[cells_of] + 1
                own = np.unique(np.repeat(lo[cells_of] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))
                at.append(np.full(len(own), i))
                to.append(own.astype(np.int32))
            take = pa.array(np.concatenate(at))
            bits = np.packbits(seen, axis=1)
            packed = pa.array([r.tobytes() for r in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), batch.column(0).take(take), batch.column(1).take(take), packed.take(take)], names=["shard", "id", "vec", "cells"])

    row = F.xxhash64("id", "vec")
    block = F.pmod(row, F.lit(blocks)).cast("int")
    asked = asking.mapInArrow(visit, T.StructType([T.StructField("shard", T.IntegerType()), *table.schema.fields, T.StructField("cells", T.BinaryType())])).withColumn("row", row).withColumn("block", block)
    of_cell = lambda x: F.element_at(F.lit(x.tolist()), F.col("cell") + 1)
    held_in = F.floor((of_cell(begin) + F.pmod(F.col("row"), of_cell(np.maximum(counts, 1)))) / shard_rows).cast("int")
    entries = coded.withColumn("row", row).withColumn("shard", held_in).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def rerank(e: pa.Table, q: pa.Table) -> pa.Table:
        schema = pa.schema([("row", pa.int64()), ("id", q.schema.field("id").type), ("other", q.schema.field("id").type), ("other_row", pa.int64()), ("distance", pa.float64())])
        if not e.num_rows or not q.num_rows:
            return schema.empty_table()
        y, x = matrix(e["vec"], d), matrix(q["vec"], d)
        cell = e["cell"].to_numpy()
        code = pa.chunked_array([*e["id"].chunks, *q["id"].chunks]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        e_code, q_code = code[: len(y)], code[len(y) :]
        open_ = np.unpackbits(utf8(q["cells"])[0].reshape(len(x), -1), axis=1, count=cells).astype(bool)
        norm = (y**2).sum(1)
        left, right, dist = [], [], []
        for i in range(0, len(x), 256):
            part = slice(i, i + 256)
            s = norm - 2 * (x[part] @ y.T)
            s[~open_[part][:, cell] | (q_code[part, None] == e_code)] = np.inf
            m = min(k, len(y))
            # all that tie with the m-th stay: the merge decides by id
            edge = np.partition(s, m - 1, axis=1)[:, m - 1 : m]
            a, b = np.nonzero((s <= edge + 1e-5) & np.isfinite(s))
            left.append(a + i)
            right.append(b)
            dist.append(np.sqrt(((x[a + i].astype(np.float64) - y[b]) ** 2).sum(1)))
        a, b, c = np.concatenate(left), np.concatenate(right), np.concatenate(dist)
        a, b = pa.array(a), pa.array(b)
        return pa.table([q["row"].take(a), q["id"].take(a), e["id"].take(b), e["row"].take(b), pa.array(c)], schema=schema)

    found = entries.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(rerank, out)
    best = found.groupBy("row", "id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "other", "other_row"))), 1, k).alias("best"))
    return best.select(F.col("id").alias("vec_id"), F.posexplode("best").alias("rank", "n")).select("vec_id", (F.col("rank") + 1).alias("rank"), F.col("n.other").alias("neighbour_id"), F.col("n.distance").alias("distance"))
