"""WordPiece ids of texts, over Arrow batches: each distinct word is split once in a worker."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD, UNKNOWN, CLS, SEP = "[PAD]", "[UNK]", "[CLS]", "[SEP]"
LENGTH = 128
_REMEMBERED = 200_000
_WORDS = regex.compile(r"[\p{P}\p{S}]|[^\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}]+")


class WordPiece:
    def __init__(self, vocabulary: Mapping[str, int], length: int = LENGTH, lower: bool = False):
        for t in (UNKNOWN, CLS, SEP, PAD):
            if t not in vocabulary:
                raise ValueError(f"the vocabulary lacks {t}")
        self.vocabulary, self.length, self.lower = dict(vocabulary), length, lower
        self.known: dict[str, list[int]] = {}

    @classmethod
    def read(cls, path: str, length: int = LENGTH) -> WordPiece:
        """A vocabulary file: a token's id is its line's number, blank lines counted. Whether to lower case says do_lower_case in a tokenizer_config.json beside it."""
        tokens = Path(path).read_text(encoding="utf-8").split("\n")
        beside = Path(path).parent / "tokenizer_config.json"
        lower = bool(json.loads(beside.read_text()).get("do_lower_case", False)) if beside.exists() else False
        return cls({t.rstrip("\r"): i for i, t in enumerate(tokens) if t.rstrip("\r")}, length, lower)

    def words(self, text: str) -> Iterator[str]:
        """Words of the compatibility form; white space and control characters part them, a punctuation mark or symbol is a word."""
        text = unicodedata.normalize("NFKC", text)
        if self.lower:  # each character by itself: a sigma has no final form then
            text = text.replace("Σ", "σ").lower()
        return (m[0] for m in _WORDS.finditer(text))

    def split(self, word: str) -> list[int]:
        """The longest known pieces from the left; the unknown token alone if that fails anywhere."""
        at, out = 0, []
        while at < len(word):
            mark = "##" if at else ""
            end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in self.vocabulary), 0)
            if not end:
                return [self.vocabulary[UNKNOWN]]
            out.append(self.vocabulary[mark + word[at:end]])
            at = end
        return out

    def pieces(self, text: str) -> list[int]:
        """The ids between the marks, cut off at the length; words beyond it change nothing and are not split."""
        most, out, known = max(0, self.length - 2), [], self.known
        if len(known) > _REMEMBERED:
            known.clear()
        for w in self.words(text):
            own = known.get(w)
            if own is None:
                own = known[w] = self.split(w)
            out += own
            if len(out) >= most:
                break
        return out[:most]

    def encode_all(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask, a row for each text."""
        first, last = self.vocabulary[CLS], self.vocabulary[SEP]
        rows = [[first, *self.pieces(t or ""), last][: self.length] for t in texts]
        ids, mask = np.full((len(rows), self.length), self.vocabulary[PAD], np.int32), np.zeros((len(rows), self.length), np.int32)
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        inside = np.arange(self.length) < size[:, None]
        ids[inside] = np.fromiter(chain.from_iterable(rows), np.int32, int(size.sum()))
        mask[inside] = 1
        return ids, mask

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        ids, mask = self.encode_all([text])
        return ids[0].tolist(), mask[0].tolist()


def encode(df: DataFrame, model: WordPiece, text: str = "text") -> DataFrame:
    """df with input_ids and attention_mask, each of the model's length; null for null text. The vocabulary is broadcast: it is as large as its file."""
    shared, model_length = df.sparkSession.sparkContext.broadcast(model), model.length

    @F.arrow_udf("input_ids array<int>, attention_mask array<int>")
    def run(column: pa.Array) -> pa.Array:
        at = pa.array(np.arange(len(column) + 1, dtype=np.int32) * model_length)
        cells = [pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in shared.value.encode_all(column.to_pylist())]
        return pa.StructArray.from_arrays(cells, ["input_ids", "attention_mask"], mask=column.is_null() if column.null_count else None)

    return df.withColumn("__w", run(F.col(text))).select(*(F.col(f"`{c}`") for c in df.columns), "__w.input_ids", "__w.attention_mask")


def input_length(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, x: a + x)
