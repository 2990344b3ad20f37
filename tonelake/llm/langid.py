"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: for every context of up to ``order`` bytes that its training texts hold, the counts of the
bytes that followed. With method C, a byte seen after the longest known context costs -log2(count / (total + distinct)) bits; otherwise an
escape of -log2(distinct / (total + distinct)) bits is paid and the next shorter context is tried, down to the empty one and then a
uniform choice among 256 bytes. Exclusion is not used. The statistics are frozen after training; a text's exact code length under
every language is the sum over all its bytes, and the shortest code wins.

For scoring, the trees are compiled into one automaton: a byte's cost depends only on the bytes in the longest context that any language
knows, so each context node holds a row of 256 costs for every language, already summed along the escapes.

Training reads at most ``train_docs`` whole documents of each label, those with the least hash of their id: a documented, fixed bound, so the
model has about the same size whatever the table's. Everything else covers all rows and whole texts.

Cases: null or empty text has null language, null bits and is rejected. Ties go to the alphabetically first language. Text is scored in
lower case with runs of white space as one space; a text of white space only counts as empty. Rows without a label, text or id are not trained on. With no
labelled rows at all there is no model: every row is rejected, with null language; an empty table gives an empty result. Repeated rows are scored alike, each as a row; in training
each counts. Texts are scored whole, however long. Columns besides id, text and label are ignored, whatever their names, and kept where rows are filtered.

The automaton's table has width ** order places of four bytes, width being one more than the bytes that training texts hold: more than ``_MOST_STATES`` is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import utf8

ORDER, TRAIN_DOCS, MOST_BITS = 3, 40, 7.0
_MOST_STATES = 1 << 25


class Ppm:
    """Frozen context trees of several languages, compiled for scoring. tables: one int64 array of node numbers for each order."""

    def __init__(self, langs: list[str], order: int, symbols: np.ndarray, nodes: list[np.ndarray], cost: np.ndarray):
        #: symbols: byte -> class (0: seen in no language). nodes[k]: sorted codes of the known contexts of k bytes. cost: [node, class, language], in bits
        self.langs, self.order, self.symbols, self.nodes, self.cost = langs, order, symbols, nodes, cost
        self._first = None

    @classmethod
    def train(cls, texts: dict[str, list[bytes]], order: int = ORDER) -> Ppm:
        langs = sorted(texts)
        used = np.zeros(256, bool)
        for l in langs:
            for t in texts[l]:
                used[np.unique(np.frombuffer(t, np.uint8))] = True
        symbols = np.where(used, np.cumsum(used), 0).astype(np.int64)
        width = int(used.sum()) + 1
        if width**order > _MOST_STATES:
            raise ValueError(f"contexts of {order} of {width} classes of bytes need a table of {width**order} places; {_MOST_STATES} is the most: lower the order")
        counts: list[list[tuple[np.ndarray, np.ndarray]]] = []  # [order][language]: codes of context and symbol, with their counts
        for k in range(order + 1):
            row = []
            for l in langs:
                codes = [np.zeros(0, np.int64)]
                for t in texts[l]:
                    s = symbols[np.frombuffer(t, np.uint8)]
                    if len(s) > k:
                        c = np.zeros(len(s) - k, np.int64)
                        for j in range(k + 1):
                            c = c * width + s[j : len(s) - k + j]
                        codes.append(c)
                row.append(np.unique(np.concatenate(codes), return_counts=True))
            counts.append(row)
        nodes = [np.unique(np.concatenate([c // width for c, _ in row])) if k else np.zeros(1, np.int64) for k, row in enumerate(counts)]
        base = np.full((1, width, len(langs)), 8.0)  # order -1: uniform
        cost = []
        for k in range(order + 1):
            if k == 0:
                below = base
            else:
                shorter = np.searchsorted(nodes[k - 1], nodes[k] % width ** (k - 1)) if k > 1 else np.zeros(len(nodes[k]), np.int64)
                below = cost[k - 1][shorter]
            own = np.array(np.broadcast_to(below, (len(nodes[k]), width, len(langs))))
            for i, (codes, n) in enumerate(counts[k]):
                if not len(codes):
                    continue
                at, sym = np.searchsorted(nodes[k], codes // width) if k else np.zeros(len(codes), np.int64), codes % width
                total = np.bincount(at, n, len(nodes[k]))
                distinct = np.bincount(at, minlength=len(nodes[k]))
                known = total > 0
                own[known, :, i] += -np.log2(distinct[known] / (total + distinct)[known])[:, None]
                own[at, sym, i] = -np.log2(n / (total + distinct)[at])
            cost.append(own)
        return cls(langs, order, symbols, nodes, np.concatenate(cost).astype(np.float32))

    def _compile(self) -> None:
        width, at = self.cost.shape[1], np.cumsum([0, *map(len, self.nodes)])
        # the longest known suffix of any ``order`` symbols, as a dense table
        table = np.zeros(1, np.int32)
        for k in range(1, self.order + 1):
            table = np.tile(table, width)  # a symbol further back is the more significant digit
            table[self.nodes[k]] = at[k] + np.arange(len(self.nodes[k]))
        self._first = table

    def bits(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code lengths [text, language] of the texts raw[at[i]:at[i + 1]]. A text's first bytes have the shorter contexts that are there."""
        if self._first is None:
            self._compile()
        n, width, k = len(at) - 1, self.cost.shape[1], self.order
        out = np.zeros((n, len(self.langs)))
        flat = self.cost.reshape(-1, len(self.langs))
        step = 1 << 18
        i = 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1))
            lo, hi = int(at[i]), int(at[j])
            starts = at[i:j]
            for p in range(lo, hi, step):  # more than one turn for very long texts only
                q = min(hi, p + step)
                s = self.symbols[raw[max(lo, p - k) : q]]
                m, pad = q - p, p - max(lo, p - k)
                ctx = np.zeros(m, np.int64)
                full = np.concatenate([np.zeros(k - pad, np.int64), s])
                for d in range(k):
                    ctx = ctx * width + full[d : d + m]
                node = self._first[ctx].astype(np.int64)
                own = starts[(starts >= p - k) & (starts < q)]
                for d in reversed(range(k)):  # a text's first bytes must not see the text before; the nearest start counts
                    for_d = own + d
                    for_d = for_d[(for_d >= p) & (for_d < q)]
                    if len(for_d):
                        node[for_d - p] = self._short(raw, for_d - d, d, width)
                where = node * width + full[k : k + m]
                cost = flat[where]
                a, b = np.clip(at[i:j], p, q) - p, np.clip(at[i + 1 : j + 1], p, q) - p
                some = b > a
                if some.any():
                    out[i:j][some] += np.add.reduceat(cost, a[some], axis=0, dtype=np.float64)
            i = j
        return out

    def _short(self, raw: np.ndarray, starts: np.ndarray, d: int, width: int) -> np.ndarray:
        """Nodes of the contexts that are the first d bytes of texts. Positions may lie past a text's end; what holds for the next text then replaces them."""
        node = np.zeros(len(starts), np.int64)
        offset = 1
        for k in range(1, d + 1):
            c = np.zeros(len(starts), np.int64)
            for x in range(d - k, d):
                c = c * width + self.symbols[raw[np.minimum(starts + x, len(raw) - 1)]]
            i = np.minimum(np.searchsorted(self.nodes[k], c), len(self.nodes[k]) - 1)
            node = np.where(self.nodes[k][i] == c, offset + i, node)
            offset += len(self.nodes[k])
        return node


def _plain(text: str):
    return F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " "))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *, order: int = ORDER, train_docs: int = TRAIN_DOCS) -> Ppm | None:
    """The model of docs' labelled rows, from at most ``train_docs`` whole texts of each language; None without any."""
    rows = docs.select(F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id)).alias("h"), F.col(doc_id).alias("id"), F.col(text).alias("text")).where("lang is not null and id is not null and trim(text) <> ''")
    first = Window.partitionBy("lang").orderBy("h", "id", F.xxhash64("text"))
    texts: dict[str, list[bytes]] = {}
    for row in rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= train_docs).select("lang", _plain("text").alias("text")).collect():  # bounded: train_docs of each label
        texts.setdefault(row.lang, []).append(row.text.encode())
    return Ppm.train(texts, order) if texts else None


def _scorer(docs: DataFrame, model: Ppm | None, most_bits: float):
    """An Arrow UDF from plain text to (pred_lang, bits_per_byte, margin_bits_per_byte, accepted)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by train_docs
    names = ["pred_lang", "bits_per_byte", "margin_bits_per_byte", "accepted"]

    @F.arrow_udf("pred_lang string, bits_per_byte double, margin_bits_per_byte double, accepted boolean")
    def score(text: pa.Array) -> pa.Array:
        m = shared.value
        raw, at = utf8(text)
        size = np.diff(at)
        n = len(size)
        if m is None or not n:
            none = pa.nulls(n, pa.float64())
            return pa.StructArray.from_arrays([pa.nulls(n, pa.string()), none, none, pa.array(np.zeros(n, bool))], names)
        bits, empty = m.bits(raw, at), size == 0
        each = np.sort(bits, 1) / np.maximum(size, 1)[:, None]
        gap = each[:, 1] - each[:, 0] if len(m.langs) > 1 else np.full(n, np.nan)
        return pa.StructArray.from_arrays(
            [pa.array(np.array(m.langs, object)[bits.argmin(1)], pa.string(), mask=empty), pa.array(each[:, 0], mask=empty), pa.array(gap, mask=empty | np.isnan(gap)), pa.array(~empty & (each[:, 0] <= most_bits))], names
        )

    return score


def identify(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *, model: Ppm | None = None, order: int = ORDER, train_docs: int = TRAIN_DOCS, most_bits: float = MOST_BITS
) -> DataFrame:
    """(doc_id, lang, pred_lang, bits_per_byte, margin_bits_per_byte, accepted): the best language, its cost, and by how much the runner-up's is higher.

    A document is accepted if its best code takes at most ``most_bits`` bits a byte: noise, and text in none of the languages, cost more.
    """
    model = model or train(docs, doc_id, text, lang, order=order, train_docs=train_docs)
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), _scorer(docs, model, most_bits)(_plain(text)).alias("found"))
    return found.select("doc_id", "lang", "found.*")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", *, model: Ppm | None = None, order: int = ORDER, train_docs: int = TRAIN_DOCS, most_bits: float = MOST_BITS) -> DataFrame:
    """docs with the same columns, without the rows that ``identify`` rejects."""
    model = model or train(docs, doc_id, text, lang, order=order, train_docs=train_docs)
    return docs.where(_scorer(docs, model, most_bits)(_plain(text))["accepted"])
