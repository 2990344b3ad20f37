"""Token ids as patched frame-of-reference (PFOR) blocks.

Ids are cut into blocks of ``block`` values (a document's last block may be shorter; no block spans documents). From each block its
minimum is subtracted; the rest is packed at the width that holds ``percentile`` of the block's values. What doesn't fit is an exception:
its low bits are packed with the others, its high bits and its place go to the exception lists. A document is one binary value, and an
index gives each block's start in it, so any block is read alone.

Layout of a block, little-endian: uint16 number of values, uint8 width, uint8 unused, uint32 minimum, uint16 number of exceptions n, n x uint16
places, n x uint32 high bits, then the packed low bits, value after value from the least significant bit, to a whole byte.

Cases: null ids give null; no ids give an empty value and an empty index. Ids must be in 0 .. 2**32 - 1, else it is an error; so is a null inside a list.
Blocks of equal values have width 0. An empty table gives an empty result; a text may be of any length, its blocks are many then. Repeated rows are packed alike. Rows keep their order and number; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, tokenizer
from .common import lists, utf8

BLOCK, PERCENTILE = 512, 0.95
_HEAD = np.dtype([("n", "<u2"), ("width", "u1"), ("unused", "u1"), ("least", "<u4"), ("exceptions", "<u2")])


def pack(ids: np.ndarray, counts: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all documents, each document's number of bytes, block starts within the documents, and each document's number of blocks."""
    if not 1 <= block <= 65535:
        raise ValueError("a block has 1 to 65535 values")
    blocks = -(-counts // block)
    nb = int(blocks.sum())
    if not nb:
        return np.zeros(0, np.uint8), np.zeros(len(counts), np.int64), np.zeros(0, np.int32), blocks
    doc = np.repeat(np.arange(len(counts)), blocks)
    nth = np.arange(nb) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(counts[doc] - nth * block, block)
    at = np.cumsum(size) - size
    least = np.minimum.reduceat(ids, at)
    # a matrix of blocks, short ones padded by zeros
    rest = np.zeros((nb, block), np.uint32)
    inside = np.arange(block) < size[:, None]
    rest[inside] = ids - np.repeat(least, size)
    # bits that each value needs; a block's width: the least that holds the percentile
    bits = np.maximum((rest.astype(np.float64).view(np.int64) >> 52) - 1022, 0).astype(np.int8)
    need = np.ceil(percentile * size).astype(np.int64)
    order = np.sort(np.where(inside, bits, 64), axis=1)
    width = order[np.arange(nb), need - 1].astype(np.int64)
    over = (bits > width[:, None]) & inside
    n_over = over.sum(1)
    packed_size = (size * width + 7) // 8
    block_size = _HEAD.itemsize + 6 * n_over + packed_size
    start = np.cumsum(block_size) - block_size
    out = np.zeros(int(block_size.sum()), np.uint8)
    head = np.zeros(nb, _HEAD)
    head["n"], head["width"], head["least"], head["exceptions"] = size, width, least, n_over
    out[(start[:, None] + np.arange(_HEAD.itemsize)).ravel()] = head.view(np.uint8)
    b, place = np.nonzero(over)
    if len(b):
        k = np.arange(len(b)) - (np.cumsum(n_over) - n_over)[b]
        where = start[b] + _HEAD.itemsize + 2 * k
        out[(where[:, None] + np.arange(2)).ravel()] = place.astype("<u2").view(np.uint8)
        where = start[b] + _HEAD.itemsize + 2 * n_over[b] + 4 * k
        out[(where[:, None] + np.arange(4)).ravel()] = (rest[b, place] >> width[b].astype(np.uint32)).astype("<u4").view(np.uint8)
    body = start + _HEAD.itemsize + 6 * n_over
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        data = _packed(rest[own], w)
        n = packed_size[own]
        to = np.repeat(body[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[to] = data[np.arange(data.shape[1]) < n[:, None]]
    first = np.searchsorted(doc, np.arange(len(counts)))
    bounds = np.append(start, len(out))
    doc_bytes = bounds[np.minimum(first + blocks, nb)] - bounds[np.minimum(first, nb)]
    return out, doc_bytes, (start - bounds[first][doc]).astype(np.int32), blocks


def _packed(rows: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each row's values, one after another: 64 values fill w words of 64 bits."""
    pad = -rows.shape[1] % 64
    x = np.pad(rows, ((0, 0), (0, pad))) if pad else rows
    lanes = np.ascontiguousarray((x & np.uint32((1 << w) - 1)).reshape(-1, 64).T).astype(np.uint64)
    words = np.zeros((w, lanes.shape[1]), np.uint64)
    for v in range(64):
        word, shift = divmod(v * w, 64)
        words[word] |= lanes[v] << np.uint64(shift)
        if shift + w > 64:
            words[word + 1] |= lanes[v] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(rows), -1)


def unpack_block(data: bytes, start: int) -> np.ndarray:
    """The ids of the block that begins at start."""
    head = np.frombuffer(data, _HEAD, 1, start)[0]
    n, w, k, at = int(head["n"]), int(head["width"]), int(head["exceptions"]), start + _HEAD.itemsize
    place, high = np.frombuffer(data, "<u2", k, at), np.frombuffer(data, "<u4", k, at + 2 * k)
    values = np.zeros(n, np.uint64)
    if w:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, (n * w + 7) // 8, at + 6 * k), count=n * w, bitorder="little").reshape(n, w)
        values = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(w, dtype=np.uint64))
    values[place] += high.astype(np.uint64) << np.uint64(w)
    return (values + np.uint64(head["least"])).astype(np.int64)


def unpack(data: bytes, starts) -> np.ndarray:
    """All ids of a document."""
    return np.concatenate([np.zeros(0, np.int64), *(unpack_block(data, int(s)) for s in starts)])


_OUT = "n_tokens int, blocks binary, block_starts array<int>"


def _struct(ids: np.ndarray, n: np.ndarray, mask: pa.Array | None, block: int, percentile: float) -> pa.Array:
    data, size, starts, blocks = pack(ids, n, block, percentile)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(data)]).cast(pa.binary())
    return pa.StructArray.from_arrays([pa.array(n.astype(np.int32)), binary, lists(starts, blocks)], ["n_tokens", "blocks", "block_starts"], mask=mask)


def pack_column(ids: Column, block: int = BLOCK, percentile: float = PERCENTILE) -> Column:
    """struct(n_tokens, blocks, block_starts) of a column of id lists."""

    @F.arrow_udf(_OUT)
    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        if flat.null_count or (len(flat) and not 0 <= pc.min(flat).as_py() <= pc.max(flat).as_py() < 2**32):
            raise ValueError("an id is null or not in 0 .. 2**32 - 1")
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        return _struct(flat.to_numpy(), n, column.is_null() if column.null_count else None, block, percentile)

    return run(ids.cast("array<bigint>"))


def unpack_column(blocks: Column, starts: Column) -> Column:
    """The id lists of packed documents; null where blocks is."""

    @F.arrow_udf("array<bigint>")
    def run(data: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([None if d is None else unpack(d, s) for d, s in zip(data.to_pylist(), at.to_pylist(), strict=True)], pa.list_(pa.int64()))

    return run(blocks, starts)


def tokenize_and_pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, block: int = BLOCK, percentile: float = PERCENTILE) -> DataFrame:
    """(doc_id, n_tokens, blocks, block_starts): byte-level BPE ids of each text, packed in the same pass."""

    @F.arrow_udf(_OUT)
    def run(column: pa.Array) -> pa.Array:
        mask = column.is_null() if column.null_count else None
        at, parts, i = utf8(column)[1], [], 0
        while i < len(column):  # a few MB of text at a time
            j = min(len(column), max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1))
            ids, n = tokenizer(vocabulary).encode(column.slice(i, j - i), offsets=False)
            parts.append(_struct(ids, n, mask.slice(i, j - i) if mask is not None else None, block, percentile))
            i = j
        return pa.concat_arrays(parts) if parts else _struct(np.zeros(0, np.int32), np.zeros(0, np.int64), None, block, percentile)

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("p")).select("doc_id", "p.*")
