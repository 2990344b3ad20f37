"""Byte-level BPE with the tokenizers library, over Arrow batches.

A batch is cut into pre-tokens with the rules of the byte-level pre-tokenizer (checked against the library by tests; what kind of character
a code point is, is asked of the library itself). Merges never cross pre-tokens, so each distinct pre-token goes through the
library once in a worker, and the ids are then laid out in text order; what a worker remembers is bounded, and is found by the pre-token's bytes. Offsets come from the byte table: a token's bytes are counted off against the
text's bytes, and bytes are mapped to characters; a token that holds only part of a character gets that character's whole span.
Decoding looks up each id's bytes, concatenates, and reads UTF-8: characters that are split over tokens come together again.

Cases: null text gives null lists; empty text gives empty lists. Special tokens in a text are ordinary text. Rows keep their order and number, so
repeated rows are encoded alike. An empty table gives an empty result. A text goes through whole, however long it is: a batch comes back in parts of whole texts. Decoding ids that are not UTF-8 gives U+FFFD for what is malformed; an id outside the vocabulary, or null
inside a list, is an error, and so is a vocabulary file with another pre-tokenizer, normalizer or kind of model. Columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lists, utf8
from .words import loads, same_slices, slice_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

L, N, O, S, NONE = range(5)  # letter, number, other, white space; not asked yet
_BYTES, _MOST, _PART = 1 << 18, 600_000, 1 << 20


def byte_table() -> dict[str, int]:
    """The printable stand-in character of each byte, as byte-level vocabularies write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _check(file: dict, path: str) -> None:
    """Other settings than those that ``cuts`` and ``_remember`` follow would silently give other ids."""
    pre, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: the pre-tokenizer must be ByteLevel with its regular expression and without prefix space; it is {pre}")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or odd or file.get("normalizer"):
        raise ValueError(f"{path}: the model must be plain byte-level BPE without a normalizer; it has {odd or [model.get('type'), file.get('normalizer')]}")


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        _check(json.loads(self.tok.to_str()), path)
        self.tok.encode_special_tokens = True
        table, vocab = byte_table(), self.tok.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        size = max(vocab.values()) + 1
        pieces = [b""] * size
        for t, i in vocab.items():
            pieces[i] = added[i].encode() if i in added else bytes(table[c] for c in t)
        self.size = np.array([len(p) for p in pieces], np.int32)
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.kind = np.full(0x110000, NONE, np.uint8)
        inverse = {b: c for c, b in table.items()}
        self.stand_in = {b: inverse[b] for b in range(256)}
        self._clear()

    def _clear(self) -> None:
        """Forgets all pre-tokens. known: bytes -> place in first (of its ids in flat) and many."""
        self.known: dict[bytes, int] = {}
        self.first, self.many, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32)
        self.used = 0

    def _remember(self, strings: list[bytes]) -> None:
        stand_in, call = self.stand_in, self.tok.model.tokenize
        own = [[t.id for t in call("".join([stand_in[b] for b in x]))] for x in strings]
        n, at = len(self.known), self.used
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        ids = np.array([x for o in own for x in o], np.int32)
        while len(self.first) < n + len(own):
            self.first, self.many = np.append(self.first, np.zeros_like(self.first)), np.append(self.many, np.zeros_like(self.many))
        while len(self.flat) < at + len(ids):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.flat[at : at + len(ids)] = ids
        self.first[n : n + len(own)] = at + np.cumsum(sizes) - sizes
        self.many[n : n + len(own)] = sizes
        self.used = at + len(ids)
        self.known.update(zip(strings, range(n, n + len(own)), strict=True))

    def _learn(self, points: np.ndarray) -> None:
        """Asks the library which kind each new code point is: it joins with one of its kind."""
        for c in points.tolist():
            ch = chr(c)
            self.kind[c] = next((k for k, x in ((L, "a"), (N, "1"), (O, "!")) if len(self.tok.pre_tokenizer.pre_tokenize_str(x + ch)) == 1), S)

    def cuts(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin in the code points of texts points[at[i]:at[i + 1]]."""
        n = len(points)
        kind = self.kind[points]
        if (kind == NONE).any():
            self._learn(np.unique(points[kind == NONE]))
            kind = self.kind[points]
        first = np.zeros(n + 1, bool)
        first[at] = True  # also the end
        change = first[:-1].copy()
        change[1:] |= kind[1:] != kind[:-1]
        white = kind == S
        begins = change.copy()
        last = np.empty(n, bool)  # white space that something else follows
        last[-1:] = False
        np.logical_and(white[:-1], ~white[1:], out=last[:-1])
        last &= ~first[1:]
        begins |= last  # the last white-space character stands alone, or goes with what follows if it is a blank
        glued = np.flatnonzero(last & (points == 32)) + 1
        begins[glued] = False
        quotes = np.flatnonzero((points == 39) & change)
        if len(quotes):
            quotes = quotes[quotes + 1 < n]
            quotes = quotes[~first[quotes + 1] & (kind[quotes + 1] == L)]
            own = begins[quotes]  # not after a blank
            quotes = quotes[own]
            if len(quotes):
                a = points[quotes + 1]
                two = quotes + 2 < n
                b = np.where(two, points[np.minimum(quotes + 2, n - 1)], 0)
                b = np.where(first[np.minimum(quotes + 2, n)], 0, b)
                one = np.isin(a, [ord(c) for c in "stmd"])
                pair = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
                for q, w in ((quotes[one], 2), (quotes[pair], 3)):
                    begins[q + 1] = False
                    after = q + w
                    begins[after[after < n]] = True
        return np.flatnonzero(begins)

    def encode(self, column, offsets: bool = True) -> tuple[np.ndarray, ...]:
        """ids, starts, ends (in characters of the text) of all tokens, and each text's number of tokens; without offsets, only ids and numbers."""
        raw, at = utf8(column)
        parts, counts = [], np.zeros(len(at) - 1, np.int64)
        i = 0
        while i < len(at) - 1:  # blocks of whole texts that stay in the processor's cache
            j = min(len(at) - 1, max(i + 1, int(np.searchsorted(at, at[i] + _BYTES, "right")) - 1))
            block = raw[at[i] : at[j]]
            if len(block):
                *tokens, counts[i:j] = self._block(block, at[i : j + 1] - at[i], offsets)
                parts.append(tokens)
            i = j
        if not parts:
            return *(np.zeros(0, np.int32) for _ in range(3 if offsets else 1)), counts
        return *(np.concatenate(x) for x in zip(*parts, strict=True)), counts

    def _block(self, raw: np.ndarray, at: np.ndarray, offsets: bool):
        lead = (raw & 0xC0) != 0x80
        chars = np.zeros(len(raw) + 1, np.int32)  # byte -> character
        np.cumsum(lead, out=chars[1:])
        data = raw.tobytes()
        if chars[-1] == len(raw):
            points, text_at = raw.astype(np.uint32), at
        else:
            points, text_at = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32), chars[at].astype(np.int64)
        cut = self.cuts(points, text_at)
        first = cut if chars[-1] == len(raw) else np.flatnonzero(lead)[cut]  # in bytes
        stop = np.append(first[1:], len(raw))
        eight = loads(raw)
        _, pick, inverse = np.unique(slice_hashes(eight, first, stop), return_index=True, return_inverse=True)
        if not same_slices(eight, first, stop, first[pick][inverse], stop[pick][inverse]):  # a collision of hashes: every pre-token by itself
            pick = inverse = np.arange(len(first))
        if len(self.known) > _MOST:
            self._clear()
        each = [data[x:y] for x, y in zip(first[pick].tolist(), stop[pick].tolist(), strict=True)]
        if unknown := list(dict.fromkeys(x for x in each if x not in self.known)):
            self._remember(unknown)
        which = np.fromiter(map(self.known.__getitem__, each), np.int64, len(each))
        which = which[inverse]
        n = self.many[which]
        end = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=end[1:])
        ids = self.flat[np.repeat(self.first[which] - end[:-1], n) + np.arange(end[-1])]
        per_text = np.diff(end[np.searchsorted(first, at)])
        if not offsets:
            return ids, per_text
        size = self.size[ids]
        hi = np.cumsum(size, dtype=np.int64)  # pre-tokens cover the block, so tokens do
        shift = np.repeat(text_at[:-1].astype(np.int32), per_text)
        return ids, chars[hi - size + 1] - 1 - shift, chars[hi] - shift, per_text

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of the id lists, as UTF-8 strings."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids].astype(np.int64)
        end = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=end[1:])
        data = np.empty(int(end[-1]), np.uint8)
        for i in range(0, len(ids), 1 << 20):
            n = size[i : i + (1 << 20)]
            e = end[i : i + len(n)]
            take = np.arange(int(n.sum())) + np.repeat(self.start[ids[i : i + (1 << 20)]] - (e - e[0]), n)
            data[e[0] : e[0] + len(take)] = self.bytes[take]
        at = end[np.concatenate([[0], np.cumsum(counts)])]
        whole = data.tobytes()
        try:
            whole.decode()  # valid as a whole, and
            if len(whole) and ((data[at[at < len(whole)]] & 0xC0) == 0x80).any():  # cut between characters
                raise UnicodeDecodeError("utf-8", b"", 0, 1, "split")
        except UnicodeDecodeError:
            return pa.array([whole[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())
        return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(at), pa.py_buffer(whole)).cast(pa.string())


@lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteBpe:
    """One for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return ByteBpe(path)


ENCODED = "ids array<int>, starts array<int>, ends array<int>"


def _nulls(column: pa.Array) -> pa.Array | None:
    return column.is_null() if column.null_count else None


def encode_column(text: Column, vocabulary: str = VOCABULARY, check: bool = False) -> Column:
    """struct(ids, starts, ends) of a text column, all null where the text is; with check also decoded_ok: decoding the ids gives the text."""

    @F.arrow_udf(ENCODED + (", decoded_ok boolean" if check else ""))
    def run(column: pa.Array) -> pa.Array:
        t = tokenizer(vocabulary)
        ids, starts, ends, n = t.encode(column)
        parts, names = [lists(x, n) for x in (ids, starts, ends)], ["ids", "starts", "ends"]
        if check:
            back = t.decode(ids, n)
            parts.append(pc.equal(back, column.cast(pa.string())))
            names.append("decoded_ok")
        return pa.StructArray.from_arrays(parts, names, mask=_nulls(column))

    return run(text)


def decode_column(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of a column of id lists; null where the list is."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("an id is null")
        n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out = tokenizer(vocabulary).decode(flat.to_numpy().astype(np.int32), n)
        return pc.if_else(column.is_null(), pa.scalar(None, pa.string()), out) if column.null_count else out

    return run(ids.cast("array<int>"))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, starts, ends, n_tokens, decoded_ok) for every row. A batch comes back in parts of about ``_PART`` bytes of text, so that neither side holds much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        for batch in batches:
            at, i = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))]), 0
            while i < batch.num_rows:
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(at, at[i] + _PART, "right")) - 1))
                part, key = batch.column(1).slice(i, j - i), batch.column(0).slice(i, j - i)
                mask, (ids, starts, ends, n) = _nulls(part), t.encode(part)
                ok = pc.equal(t.decode(ids, n), part.cast(pa.string()))
                many = pa.array(n.astype(np.int32), mask=part.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([key, *(lists(x, n, mask) for x in (ids, starts, ends)), many, ok], names=["doc_id", "ids", "starts", "ends", "n_tokens", "decoded_ok"])
                i = j

    kind = T.StructField("doc_id", docs.schema[doc_id].dataType)
    schema = T.StructType([kind, *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends")), T.StructField("n_tokens", T.IntegerType()), T.StructField("decoded_ok", T.BooleanType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
