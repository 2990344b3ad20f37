"""Vector tables: rows of float32 bytes, sums over all rows, for the operators on embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8, written


def vector_table(rows: DataFrame, vec_id: str, embedding: str, unit: bool) -> tuple[DataFrame, int]:
    """A written table (id, vec binary) of the usable vectors, and their dimension: the most common one, on ties the least.

    Not usable: a null vector, one with a null, NaN or infinite part, of another dimension, and with ``unit`` (scaling to length 1) the zero vector."""
    e = F.col(embedding).cast("array<float>")
    id_type = rows.schema[vec_id].dataType
    base = rows.select(F.col(vec_id).alias("id"), e.alias("e")).where("e is not null and size(e) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = batch.column(1).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype("<f4")
            at = np.concatenate([[0], np.cumsum(n)])
            ok = np.add.reduceat(~np.isfinite(flat), at[:-1]) == 0 if len(n) else np.zeros(0, bool)
            if unit and len(n):
                length = np.sqrt(np.add.reduceat(flat.astype(np.float64) ** 2, at[:-1]))
                ok &= length > 0
                flat = (flat / np.repeat(np.where(length > 0, length, 1), n)).astype("<f4")
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at * 4), pa.py_buffer(flat)]).cast(pa.binary())
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), data.filter(keep)], names=["id", "vec"])

    table = written(base.mapInArrow(run, T.StructType([T.StructField("id", id_type), T.StructField("vec", T.BinaryType())])), "vectors")
    sizes = table.groupBy(F.length("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    d = (sizes["n"] // 4) if sizes else 0
    return table.where(F.length("vec") == 4 * d), d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    raw, _ = utf8(column)
    return raw.view("<f4").reshape(-1, d)


def summed(table: DataFrame, d: int, slots: int, each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of each(vectors) over all rows, added up by Spark; only ``slots`` sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots)
        for batch in batches:
            if batch.num_rows:
                total += each(matrix(batch.column(0), d).astype(np.float64)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(slots, dtype=np.int32)), pa.array(total)], names=["slot", "value"])

    out = np.zeros(slots)
    for r in table.select("vec").mapInArrow(run, "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect():
        out[r.slot] = r.value
    return out
