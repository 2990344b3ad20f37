"""Unbounded n-gram language model scoring: longest matching contexts, summed counts, smoothed continuations.

The model is the corpus: all words of all texts (see words.py), with an end mark after each. For each position of a query text, the context is the longest string of words
before it, of any length, that the corpus holds. With c(x) the count of a word string x, the position's word w after its context h costs -log2 P(w | h) with
P(w | h) = (c(h w) + prior * P0(w)) / (c(h) + prior),  P0(w) = (c(w) + prior / vocabulary) / (words and ends in all + prior);
without any context it costs -log2 P0(w). The end mark follows a text's last word, so P(. | h) sums to 1 over words and the end where P0 does.
A position needs two places only: with L(j) the length of the longest string that ends with word j and that the corpus holds, and C(j) its count, the context of position i
has L(i-1) words and the count C(i-1), and c(h w) is C(i) if L(i) = L(i-1) + 1, else 0.

``score``: for a small set of queries. Every task cuts its texts into shards of at most ``shard_words`` words (a longer text is a shard of its own), reverses them, and sorts
each shard's suffixes: a suffix array in which all places that end with the same words are neighbours. Binary search narrows the suffixes that match a position's last
1, 2, 3, ... words. A first pass gives the longest match over all shards, a second one sums the counts of just those strings. The queries go to every task.

``score_documents``: every document of a corpus under all others; sending all documents to all suffix arrays would grow with the square of the corpus. Here a block of documents asks
for the counts of word strings by hash, in sorted lists, and the lists are merged by range of hash: lengths 1 and 2 at once, then, for the places that are still
matched elsewhere, 3 and 4, doubled lengths, and half way between two lengths whose counts differ (see ``Deep``). Places whose word always follows the words before it follow from the place before and
are not searched, which are most in near copies. So the work grows with the corpus, and the number of steps with the logarithm of the longest match.
A document's own text doesn't count; its exact copies do. Documents with equal text (case folded) are scored once, weighted by their number. Strings of words are compared by
64-bit hashes that are mixed level by level, texts by 128 bits.

Cases: a query without words (null, empty, punctuation only) has n_words 0 and null scores; corpus texts without words hold nothing. Rows with equal id and text are one
document (one query), which ``score_documents`` counts once; in ``score`` repeated corpus rows count as often as they occur. Ties cannot arise. Null ids are ids. An empty corpus gives P0; an empty table no rows.
Texts are scored whole, however long. Columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, drop_written, lists, path_of, written
from .words import mix, word_hashes

SHARD_WORDS, PRIOR, VOCABULARY_SIZE, BLOCK_WORDS, RANGE_ASKS = 1 << 20, 4.0, 1 << 20, 1 << 19, 3 << 20
_MOST_QUERY_BYTES = 64 << 20
_A = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(tokens: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Places in order of what follows them, compared token by token. stop: places of end marks; each is unlike all else, so comparison ends there.

    Prefix doubling that sorts only what is still tied."""
    n = len(tokens)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + len(stop)
    rank[stop] = np.arange(len(stop))  # end marks come first
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    # a rank is the first place of its class in the order
    start = np.flatnonzero(np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]]))
    size = np.diff(np.append(start, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(start, size)
    tied = np.flatnonzero(np.repeat(size > 1, size))  # positions in order
    step = 1
    while len(tied):
        at = order[tied]
        key = rank[at] * (n + 1) + rank[np.minimum(at + step, n - 1)]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        order[tied] = at
        first = np.concatenate([[True], key[1:] != key[:-1]])
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(key)))
        rank[at] = np.repeat(tied[begin], size)
        tied = tied[np.repeat(size > 1, size)]
        step *= 2
    return order

def matches(tokens: np.ndarray, order: np.ndarray, queries: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n = 1, 2, ...: the query places p at which queries[p : p + n] occurs among the sorted places, and how often. end[p]: where p's query ends."""
    place = np.arange(len(queries))
    lo, hi, n = np.zeros(len(queries), np.int64), np.full(len(queries), len(order)), 0
    while len(place):
        want = queries[place + n]
        both = []
        for right in (False, True):
            a, b = lo.copy(), hi.copy()
            while True:
                open_ = a < b
                if not open_.any():
                    break
                mid = (a + b) >> 1
                # all suffixes in the range share n tokens, so their next one is within the shard
                seen = tokens[np.minimum(order[np.minimum(mid, len(order) - 1)] + n, len(tokens) - 1)]
                less = (seen <= want) if right else (seen < want)
                a = np.where(open_ & less, mid + 1, a)
                b = np.where(open_ & ~less, mid, b)
            both.append(a)
        lo, hi = both
        some = hi > lo
        place, lo, hi, n = place[some], lo[some], hi[some], n + 1
        if len(place):
            yield n, place, hi - lo
        more = place + n < end[place]
        place, lo, hi = place[more], lo[more], hi[more]

def unigram(count: np.ndarray, total: np.ndarray, prior: float, vocabulary: int) -> np.ndarray:
    return (count + prior / vocabulary) / (total + prior)


def cost(length: np.ndarray, count: np.ndarray, before: np.ndarray, context: np.ndarray, p0: np.ndarray, prior: float) -> np.ndarray:
    """Bits of positions: length and count of the longest string that ends with the word, and of the one that ends before it (0 words: no context)."""
    hit = np.where(length == before + 1, count, 0)
    return -np.log2(np.where(before > 0, (hit + prior * p0) / (context + prior), p0))


def corpus_matches(docs: DataFrame, text: str, query: np.ndarray, ends: np.ndarray, shard_words: int, want: np.ndarray | None = None) -> DataFrame:
    """Without want: (place, n, 0), the longest match of each place of the reversed queries. With it: (place, n, count) for n = 1 and n = want[place], summed over all shards;
    place -1: words and ends of the corpus in all."""
    shared = docs.sparkSession.sparkContext.broadcast((query, ends, want))  # checked by the caller

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, e, wanted = shared.value
        longest = np.zeros(len(q), np.int32)
        sums = np.zeros((2, len(q)), np.int64)
        total = 0

        def search(words: list[np.ndarray]) -> None:
            nonlocal total
            flat = np.concatenate(words)
            stop = np.cumsum([len(w) for w in words]) - 1
            total += len(flat)
            order = suffix_array(flat, stop)[len(stop) :]  # without the end marks
            # end marks hold the least value and stand first, so binary search by value stays right
            for n, place, count in matches(flat, order, q, e):
                if wanted is None:
                    longest[place] = np.maximum(longest[place], n)
                else:
                    if n == 1:
                        sums[0, place] += count
                    own = wanted[place] == n
                    sums[1, place[own]] += count[own]

        waiting, size = [], 0
        for batch in batches:
            words, counts = word_hashes(batch.column(0))
            words = np.maximum(words, np.uint64(1))
            at = 0
            for c in counts[counts > 0].tolist():
                if waiting and size + c > shard_words:
                    search(waiting)
                    waiting, size = [], 0
                waiting.append(np.append(words[at : at + c][::-1], np.uint64(0)))
                size += c
                at += c
        if waiting:
            search(waiting)
        names = ["place", "n", "count"]
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([total], pa.int64())], names=names)
        for own, n in ((longest, longest),) if wanted is None else ((sums[0], np.ones(len(q), np.int32)), (np.where(wanted > 1, sums[1], 0), wanted)):
            place = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(n[place].astype(np.int32)), pa.array(own[place].astype(np.int64))], names=names)

    each = docs.select(F.lower(F.col(text)).alias("text")).mapInArrow(run, "place int, n int, count long")
    return each.groupBy("place").agg(F.max("n").alias("n"), F.sum("count").alias("count")) if want is None else each.groupBy("place", "n").agg(F.sum("count").alias("count"))


def score(
    queries: DataFrame, docs: DataFrame, query_id: str = "item_id", query_text: str = "text", text: str = "text", *,
    shard_words: int = SHARD_WORDS, prior: float = PRIOR, vocabulary: int = VOCABULARY_SIZE, most_query_bytes: int = _MOST_QUERY_BYTES,
) -> DataFrame:
    """(id, key, n_words, bits, bits_per_word, longest_match, mean_context) for each query of ``queries`` under the corpus ``docs``.

    The query words are sent to every task, and two numbers a word come back: at most ``most_query_bytes`` of them, more is an error (``score_documents`` has no such limit).
    """
    spark = docs.sparkSession
    rows = queries.select(F.col(query_id).alias("id"), doc_key(F.col(query_id), F.col(query_text)).alias("key"), F.lower(F.col(query_text)).alias("text")).dropDuplicates(["key"])
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size * 4 > most_query_bytes:
        raise ValueError(f"the queries take about {size * 4} bytes in every task; most_query_bytes is {most_query_bytes}")
    local = rows.select("key", "text").toArrow().sort_by("key")
    words, counts = word_hashes(local["text"])
    words = np.maximum(words, np.uint64(1))
    stop = np.cumsum(counts)
    # reversed within each query: position i's last words are a prefix from its place on
    owner = np.repeat(np.arange(len(counts)), counts)
    place_of = (stop - counts)[owner] + stop[owner] - 1 - np.arange(len(words))
    flat, ends = words[place_of], stop[owner]
    longest, count, single = (np.zeros(len(words), np.int64) for _ in range(3))
    found = corpus_matches(docs, text, flat, ends, shard_words).toArrow()  # a row for each place of the queries at most
    at, n, c = (found[x].to_numpy() for x in ("place", "n", "count"))
    total = int(c[at < 0].sum())
    longest[at[at >= 0]] = n[at >= 0]
    if longest.any():
        found = corpus_matches(docs, text, flat, ends, shard_words, longest).toArrow()  # two rows a place
        at, n, c = (found[x].to_numpy() for x in ("place", "n", "count"))
        one, own = (at >= 0) & (n == 1), (at >= 0) & (n == longest[at])
        single[at[one]], count[at[own]] = c[one], c[own]
    longest, count, single = longest[place_of], count[place_of], single[place_of]  # in order of the text
    first = np.zeros(len(words), bool)
    first[(stop - counts)[counts > 0]] = True
    before, context = (np.where(first, 0, np.concatenate([[0], x[:-1]])) if len(x) else x for x in (longest, count))
    bits = np.bincount(owner, cost(longest, count, before, context, unigram(single, total, prior, vocabulary), prior), len(counts))
    top = np.zeros(len(counts), np.int64)
    np.maximum.at(top, owner, longest)
    none = counts == 0
    mean = np.bincount(owner, before, len(counts)) / np.maximum(counts, 1)
    cells = [pa.array(x, mask=none) for x in (bits, bits / np.maximum(counts, 1), top.astype(np.int32), mean)]
    scored = spark.createDataFrame(pa.table([local["key"], pa.array(counts), *cells], names=["key", "n_words", "bits", "bits_per_word", "longest_match", "mean_context"]))
    return rows.join(scored, "key").select(F.col("id").alias("item_id"), "key", "n_words", "bits", "bits_per_word", "longest_match", "mean_context")


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: whole numbers in as few bytes as hold them, the low halves of all values before the high ones."""
    out = []
    for name, a in arrays.items():
        kind = a.dtype
        if kind.kind == "i" and len(a):
            most = max(int(a.max()), -int(a.min()))
            a = a.astype(np.int8 if most < 1 << 7 else np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)
        a = np.ascontiguousarray(a)
        data = np.ascontiguousarray(a.view(np.uint16).reshape(len(a), -1).T) if a.itemsize > 2 and len(a) else a
        out.append((name, kind.str, a.dtype.str, len(a), pa.compress(data.tobytes(), codec="zstd", asbytes=True) if len(a) else b""))
    return pickle.dumps(out)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, kind, held, n, cell in pickle.loads(data):
        size = np.dtype(held).itemsize
        raw = pa.decompress(cell, n * size, codec="zstd", asbytes=True) if n else b""
        a = np.frombuffer(raw, held) if size <= 2 or not n else np.ascontiguousarray(np.frombuffer(raw, np.uint16).reshape(-1, n).T).view(held).reshape(n)
        out[name] = a.astype(kind)
    return out


def by_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of hashes, and the hashes in it. Their places are packed into the low bits for the sort; where the high bits tie by chance, just those are sorted again."""
    low = np.uint64((1 << max(1, (len(h) - 1).bit_length())) - 1)
    order = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    sorted_ = h[order]
    wrong = np.flatnonzero(sorted_[1:] < sorted_[:-1])
    if len(wrong):
        high = sorted_ & ~low
        first, last = np.searchsorted(high, high[wrong], "left"), np.searchsorted(high, high[wrong], "right")
        at = np.unique(np.concatenate([np.arange(x, y) for x, y in zip(first.tolist(), last.tolist(), strict=True)]))
        own = order[at]
        order[at] = own[np.argsort(h[own], kind="stable")]
        sorted_[at] = h[order[at]]
    return order, sorted_


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = columns[0][1:] != columns[0][:-1]
        for c in columns[1:]:
            new[1:] |= c[1:] != c[:-1]
    return new


class Asks:
    """Word strings of a block by hash: the distinct ones in order with their weighted counts in the block, and for each place its string and how often its own document has it.

    h: hashes of the strings that end at places of documents doc (ascending); weight: of each document. places: whether what is said of each place is needed."""

    def __init__(self, h: np.ndarray, doc: np.ndarray, weight: np.ndarray, places: bool = True) -> None:
        n = len(h)
        if places:
            self.of, self.own = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.hash, self.local = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if not n:
            return
        order, h = by_hash(h)
        doc = doc[order]
        new = changes(h)
        start = np.flatnonzero(new)
        if places:
            runs = np.flatnonzero(new | changes(doc))
            size = np.diff(np.append(runs, n)).astype(np.int32)
            self.own[order] = np.repeat(size, size)
            self.of[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        self.hash, self.local = h[start], np.add.reduceat(weight[doc], start)

    def sent(self, ranges: int) -> Iterator[tuple[int, bytes]]:
        to = self.ranges(ranges)
        for a, b in zip(to[:-1], to[1:], strict=True):
            if b > a:
                h = self.hash[a:b]
                yield int(self.range_of(h[:1], ranges)[0]), pack(h=np.diff(h, prepend=np.uint64(0)), n=self.local[a:b])

    @staticmethod
    def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)

    def ranges(self, ranges: int) -> list[int]:
        """Where each range of hashes begins; only those that are there."""
        return [*np.flatnonzero(changes(self.range_of(self.hash, ranges))).tolist(), len(self.hash)]

    def totals(self, ranges: int, answers: dict[int, bytes]) -> np.ndarray:
        """Counts in the whole corpus: those of the block and those of other blocks."""
        out = self.local.astype(np.int64)
        to = self.ranges(ranges)
        for a, b in zip(to[:-1], to[1:], strict=True):
            if b > a and (r := int(self.range_of(self.hash[a : a + 1], ranges)[0])) in answers:
                out[a:b] += unpack(answers[r])["n"]
        return out


def merge(cells: pa.Table) -> pa.Table:
    """One range of hashes: for each block's sorted list, what all other blocks' lists add to the counts."""
    parts = [unpack(x.as_py()) for x in cells["cell"]]
    sizes = [len(p["h"]) for p in parts]
    h = np.concatenate([np.cumsum(p.pop("h"), dtype=np.uint64) for p in parts])
    n = np.concatenate([p.pop("n") for p in parts])
    order, h = by_hash(h)
    start = np.flatnonzero(changes(h))
    del parts, h
    more = np.empty(len(n), np.int64)
    more[order] = np.repeat(np.add.reduceat(n[order], start), np.diff(np.append(start, len(n))))
    del order
    more -= n
    keep, out = [], []
    for i, own in enumerate(np.split(more, np.cumsum(sizes)[:-1])):
        if own.any():
            keep.append(i)
            out.append(pack(n=own))
    return pa.table([cells["block"].take(pa.array(keep, pa.int64())), cells["range"].take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], names=["block", "range", "cell"])


class Levels:
    """Hashes of the strings of any length that end at places of a sequence of words: a string is known by the two strings of 2^k words that cover it."""

    def __init__(self, words: np.ndarray) -> None:
        self.h = [words]

    def level(self, k: int) -> np.ndarray:
        while len(self.h) <= k:
            last, s = self.h[-1], 1 << (len(self.h) - 1)
            nxt = last.copy()
            nxt[s:] *= _A
            nxt[s:] += last[:-s]
            nxt ^= nxt >> np.uint64(29)
            self.h.append(nxt)
        return self.h[k]

    def strings(self, place: np.ndarray, m: np.ndarray) -> np.ndarray:
        k = np.frexp(m.astype(np.float32))[1] - 1 if len(m) and m.max() < 1 << 24 else np.frexp(m.astype(np.float64))[1] - 1
        out = np.empty(len(place), np.uint64)
        for level in np.flatnonzero(np.bincount(k)).tolist():
            own = np.flatnonzero(k == level)
            p, n = place[own], m[own]
            h = self.level(level)
            out[own] = mix(h[p] * _A + h[p - n + (1 << level)] + n.astype(np.uint64))
        return out

    def of_length(self, place: np.ndarray, m: int) -> np.ndarray:
        """As ``strings``, for one length."""
        k = m.bit_length() - 1
        h = self.level(k)
        return mix(h[place] * _A + h[place - (m - (1 << k))] + np.uint64(m))


def opening(s: dict[str, np.ndarray], places: bool = True) -> tuple[Asks, list[np.ndarray], np.ndarray]:
    """What a block asks first: all its strings of 1 and 2 words; the places of each length; the document of each place."""
    n = s["n"]
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    levels = Levels(s["vocab"][s["word"]])
    two = np.ones(len(doc), bool)
    two[(np.cumsum(n) - n)[n > 0]] = False
    at = [np.arange(len(doc)), np.flatnonzero(two)]
    h = np.concatenate([levels.of_length(p, m) for m, p in enumerate(at, 1)])
    # strings of one hash have one length, and places ascend within each length
    return Asks(h, np.concatenate([doc, doc[at[1]]]), s["weight"], places), at, doc


class Deep:
    """The places of a block whose last two words another document holds, with the words before them, and what is known of longer strings.

    Of each open place, strings of 3, 4, 8, 16, ... words are asked for as long as another document holds them. Between two lengths a < b with equal counts all counts are equal; if
    they differ, the length half way is asked. All places of a string have the same history: if one place of an a-word string has another count at b, so have all. So all of
    them ask for the same strings in the same step, and counts are whole. A string that cannot be elsewhere, because a part of it isn't, is not asked for.

    A place whose last m + 1 words are as frequent as the m before its own word (m is 2 or 3) follows: its word comes wherever those m are, so any longer string with them is as frequent with
    the word as without it, in each document. Its longest match is that of the place before and one word more, with the same count; it isn't open. All places of a string of
    m + 1 words or more follow, or none, so counts of the others stay whole."""

    KEYS = ("word", "doc", "near", "todo", "length", "count", "own", "follows", "known", "whole", "place", "a", "at_a", "b", "at_b")

    def __init__(self, s: dict[str, np.ndarray], asking: bool = True, places: bool = True) -> None:
        """asking: whether the strings to ask for are needed; places: as in ``Asks``."""
        self.s = s
        for k in self.KEYS:
            setattr(self, k, s[k])
        self.place = np.cumsum(self.place)  # held as differences
        if self.known[0] < 4:
            self.at_a = self.whole[self.place]
        self.levels = Levels(s["vocab"][self.word])
        self.reach()
        if asking:
            self.next(places)

    def reach(self) -> None:
        """How many places in a row, up to each, end with so many words that are elsewhere."""
        alive = self.length >= int(self.known[0])
        i = np.arange(len(alive))
        self.run = i - np.maximum.accumulate(np.where(alive & self.near, -1, np.where(alive, i - 1, i)))

    def next(self, places: bool) -> None:
        """The strings to ask for. places: as in ``Asks``."""
        known = int(self.known[0])  # of all places it is known whether so many words are elsewhere
        open_ = self.open()
        self.m = np.where(self.b > 0, (self.a + self.b) >> 1, np.where(self.a < 4, self.a + 1, 2 * self.a))
        before = np.maximum(self.place - 1, 0)
        ask = (self.m < self.run[self.place] + known) & (open_[before] | (self.length[before] >= self.m - 1))
        self.ask = np.flatnonzero(ask)
        p = self.place[self.ask]
        h = self.levels.of_length(p, known + 1) if known < 4 else self.levels.strings(p, self.m[self.ask])
        self.asks = Asks(h, self.doc[p], self.s["weight"], places)

    def root(self) -> np.ndarray:
        """The place that each place follows, itself if none."""
        return np.maximum.accumulate(np.where(self.follows, 0, np.arange(len(self.follows))))

    def open(self) -> np.ndarray:
        out = np.zeros(len(self.doc), bool)
        out[self.place] = True
        return out[self.root()]

    def answer(self, totals: np.ndarray) -> None:
        count, rest = np.zeros(len(self.place), np.int64), np.zeros(len(self.place), np.int64)
        count[self.ask] = totals[self.asks.of]
        rest[self.ask] = count[self.ask] - self.asks.own
        place, a, b, at_a, at_b, m = self.place, self.a, self.b, self.at_a, self.at_b, self.m
        better = np.flatnonzero((rest > 0) & (m > self.length[place]))
        better = better[np.argsort(m[better], kind="stable")]  # the longest is set last
        self.length[place[better]], self.count[place[better]] = m[better], rest[better]
        up = (b == 0) & (rest > 0)
        if self.known[0] < 4:  # all ask for one length, known + 1
            new = np.zeros(len(place), bool)
            own = self.ask
            new[own] = (rest[own] > 0) & (count[own] == self.whole[place[own] - 1])  # the place before is there, as the string is
            self.follows[place[new]] = True
            up &= ~new
            self.whole = np.zeros(len(self.doc), np.int64)
            if self.known[0] < 3:
                self.whole[place] = count
            self.known = self.known + 1
        root = self.root()
        at = np.flatnonzero(self.follows)
        self.length[at], self.count[at] = self.length[root[at]] + (at - root[at]), self.count[root[at]]
        lower = (m - a > 1) & (at_a != count)
        upper = (b - m > 1) & (count != at_b) & (rest > 0)
        place = np.concatenate([place[up], place[lower], place[upper]])
        by = np.argsort(place, kind="stable")
        self.place = place[by]
        self.a = np.concatenate([m[up], a[lower], m[upper]])[by]
        self.at_a = np.concatenate([count[up], at_a[lower], count[upper]])[by]
        self.b = np.concatenate([np.zeros(int(up.sum()), np.int64), m[lower], b[upper]])[by]
        self.at_b = np.concatenate([np.full(int(up.sum()), -1, np.int64), count[lower], at_b[upper]])[by]
        self.reach()

    def settle(self, total: int, prior: float, vocabulary: int) -> None:
        """Adds up the positions whose counts are final, and lets go of the places that no open string and no other position needs."""
        s, size = self.s, len(self.doc)
        if not size:
            return
        n, closed = s["n"], ~self.open()
        i = np.flatnonzero(self.todo)
        i = i[closed[i] & closed[i - 1]]  # the place before is there
        p0 = unigram(s["freq"][self.word[i]] - self.own[i], total - (n + 1)[self.doc[i]], prior, vocabulary)
        s["bits"] = s["bits"] + np.bincount(self.doc[i], cost(self.length[i], self.count[i], self.length[i - 1], self.count[i - 1], p0, prior), len(n))
        s["context"] = s["context"] + np.bincount(self.doc[i], self.length[i - 1], len(n))
        start = np.flatnonzero(changes(self.doc))
        s["top"][self.doc[start]] = np.maximum(s["top"][self.doc[start]], np.maximum.reduceat(self.length, start))
        self.todo[i] = False
        # strings between two lengths lie within the longer one, others within the row of places
        first = np.maximum(self.place - np.where(self.b > 0, self.b + 2, self.run[self.place] + self.known[0] - 1), 0)
        keep = (np.cumsum(np.bincount(first, minlength=size) - np.bincount(self.place + 1, minlength=size + 1)[:size]) > 0) | self.todo
        keep[:-1] |= self.todo[1:]
        if keep.mean() > 0.75:
            return
        number = np.cumsum(keep) - 1
        self.place = number[self.place]
        near = self.near & np.concatenate([[False], keep[:-1]])
        for k in ("word", "doc", "todo", "length", "count", "own", "follows", "whole"):
            setattr(self, k, getattr(self, k)[keep])
        self.near = near[keep]
        self.follows &= self.near  # of those that lose the place before, all is known

    def state(self) -> bytes:
        keep = {k: self.s[k] for k in ("n", "weight", "bits", "context", "top")}
        used = np.zeros(len(self.s["vocab"]), bool)
        used[self.word] = True
        now = {k: getattr(self, k) for k in self.KEYS} | {"word": (np.cumsum(used) - 1)[self.word], "place": np.diff(self.place, prepend=0)}
        if self.known[0] < 4:
            now["at_a"] = self.at_a[:0]
        return pack(**keep, vocab=self.s["vocab"][used], freq=self.s["freq"][used], **now)


def begin(s: dict[str, np.ndarray], ranges: int, answers: dict[int, bytes], total: int, prior: float, vocabulary: int) -> Deep:
    """After the first answers: sums for the positions that are settled, and what is known of the others."""
    asks, (_, two), doc = opening(s)
    n, size = s["n"].astype(np.int64), len(doc)
    whole = asks.totals(ranges, answers)[asks.of]
    rest, own = whole - asks.own, asks.own[:size]
    del asks
    freq = np.zeros(len(s["vocab"]), np.int64)
    freq[s["word"]] = whole[:size]
    single, count = rest[:size], rest[:size].copy()
    length, pairs = (single > 0).astype(np.int32), np.zeros(size, np.int64)
    some = rest[size:] > 0
    length[two[some]], count[two[some]] = 2, rest[size:][some]
    pairs[two] = whole[size:]
    first = np.ones(size, bool)
    first[two] = False
    alive = length >= 2
    shift = lambda x: np.concatenate([x[:1] & False, x[:-1]])
    todo = ~first & (alive | shift(alive))
    settled = np.flatnonzero(~todo)
    before, context = (np.where(first[settled], 0, x[np.maximum(settled - 1, 0)]) for x in (length, count))
    p0 = unigram(single[settled], total - (n + 1)[doc[settled]], prior, vocabulary)
    bits = np.bincount(doc[settled], cost(length[settled], count[settled], before, context, p0, prior), len(n))
    sums = np.bincount(doc[settled], before, len(n))
    top = np.zeros(len(n), np.int64)
    start = np.flatnonzero(changes(doc))
    top[doc[start]] = np.maximum.reduceat(length, start)
    keep = np.flatnonzero(alive | np.concatenate([alive[1:], alive[:1] & False]) | todo)  # a place with two words has one before it in its document
    near = np.zeros(len(keep), bool)
    near[1:] = (keep[1:] == keep[:-1] + 1) & (doc[keep[1:]] == doc[keep[:-1]])
    place = np.flatnonzero(alive[keep])
    none = np.zeros(len(place), np.int64)
    deep = dict(
        n=n, weight=s["weight"], vocab=s["vocab"], freq=freq, bits=bits, context=sums, top=top, word=s["word"][keep], doc=doc[keep], near=near, todo=todo[keep], length=length[keep], count=count[keep],
        own=own[keep], follows=np.zeros(len(keep), bool), known=np.array([2]), whole=pairs[keep], place=np.diff(place, prepend=0), a=none + 2, at_a=none[:0], b=none, at_b=none - 1,
    )
    return Deep(deep, asking=False)


def _blocks(block_words: int):
    """Texts (a, b, weight, text) as blocks of at most block_words words; a longer text is a block of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        number, size, task = 0, 0, TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            nonlocal number
            words, n, weight, a, b = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order, h = by_hash(words)
            new = changes(h)
            start = np.flatnonzero(new)
            often = np.argsort(-np.diff(np.append(start, len(words))), kind="stable")
            rank = np.empty(len(start), np.int32)
            rank[often] = np.arange(len(start), dtype=np.int32)
            word = np.empty(len(words), np.int32)
            word[order] = rank[np.cumsum(new) - 1]
            state = pack(n=n, weight=weight, vocab=h[start][often], word=word)
            number += 1
            total = int((weight * (n + 1)).sum())
            one = np.array([len(n)])
            cells = [pa.array([task << 32 | number], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([total], pa.int64()), pa.array([state], pa.binary()), lists(a, one), lists(b, one)]
            return pa.RecordBatch.from_arrays(cells, names=["block", "open", "total", "cell", "h1", "h2"])

        for batch in batches:
            words, n = word_hashes(batch.column(3))
            end = np.cumsum(n)
            weight, a, b = batch.column(2).to_numpy(), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            i = 0
            while i < len(n):
                at = end[i] - n[i]
                j = max(i if waiting else i + 1, int(np.searchsorted(end, at + block_words - size, "right")))
                part = slice(i, j)
                some = n[part] > 0
                if some.any():
                    waiting.append((words[at : end[j - 1]], n[part][some], weight[part][some], a[part][some], b[part][some]))
                    size += int(end[j - 1] - at)
                i = j
                if waiting and i < len(n):
                    yield block()
                    waiting, size = [], 0
        if waiting:
            yield block()

    return run


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Each write deletes its shuffle files as it ends; else those of all steps stay on disk until the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def score_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, block_words: int = BLOCK_WORDS, range_asks: int = RANGE_ASKS, prior: float = PRIOR, vocabulary: int = VOCABULARY_SIZE,
) -> DataFrame:
    """(doc_id, key, n_words, bits, bits_per_word, longest_match, mean_context) for each document under all other documents.

    A step is two jobs over a written table of blocks' states: the states' lists of strings are merged by range of hash (about ``range_asks`` strings each), and blocks take the answers in.
    Lists are made from the states when they are sent, and states stay in their buckets: neither is written a second time, as what is on disk at once sets the limit.
    """
    spark = docs.sparkSession
    low = F.lower(F.col(text))
    keyed = docs.select(F.col(doc_id).alias("id"), doc_key(F.col(doc_id), F.col(text)).alias("key"), F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(1), low).alias("h2"), low.alias("t"))
    with _cleaned(spark):
        names = written(keyed.select("id", "key", "h1", "h2").distinct(), "names")
    weights = names.groupBy("h1", "h2").agg(F.count("*").alias("weight"))
    texts = keyed.where("t is not null").groupBy("h1", "h2").agg(F.first("t").alias("t")).join(weights, ["h1", "h2"]).select("h1", "h2", "weight", "t")
    schema = "block long, open long, total long, cell binary, h1 array<long>, h2 array<long>"
    with _cleaned(spark):
        table = written(texts.mapInArrow(_blocks(block_words), schema), "blocks", by="block")
    found = table.agg(F.sum("open"), F.sum("total")).first()
    words, total, step = found[0] or 0, found[1] or 0, 0
    left = words
    while left:
        ranges = -(-(left if step else 2 * words) // range_asks)  # the first lists have more strings than places

        def ask(batches: Iterator[pa.RecordBatch], *, ranges: int = ranges, first: bool = step == 0) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = unpack(data.as_py())
                    asks = opening(own, places=False)[0] if first else Deep(own, places=False).asks
                    for r, c in asks.sent(ranges):
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([r], pa.int32()), pa.array([c], pa.binary())], names=["block", "range", "cell"])

        def answer(s: pa.Table, a: pa.Table, *, ranges: int = ranges, first: bool = step == 0) -> pa.Table:
            if not s["open"][0].as_py():
                return s
            cells = dict(zip(a["range"].to_pylist(), a["cell"].to_pylist(), strict=True))
            own = unpack(s["cell"][0].as_py())
            if first:
                deep = begin(own, ranges, cells, total, prior, vocabulary)
            else:
                deep = Deep(own)
                deep.answer(deep.asks.totals(ranges, cells))
            open_ = len(deep.place)
            deep.settle(total, prior, vocabulary)
            data = deep.state() if open_ else pack(**{k: deep.s[k] for k in ("n", "bits", "top", "context")})
            return s.set_column(1, "open", pa.array([open_], pa.int64())).set_column(3, "cell", pa.array([data], pa.binary()))

        with _cleaned(spark):
            asked = table.where("open > 0").select("block", "cell").mapInArrow(ask, "block long, range int, cell binary")
            answers = asked.groupBy("range").applyInArrow(merge, "block long, range int, cell binary")
            if step < 2:  # the largest lists: they are let go before the next states are written
                answers = written(answers, "answers")
            after = written(table.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, schema), "state", by="block")
        left = after.agg(F.sum("open")).first()[0] or 0
        drop_written(spark, [path_of(answers) if step < 2 else "", path_of(table)])
        table, step = after, step + 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, bits, top, context = unpack(batch.column(2)[i].as_py()).values()  # at least one word each
                cells = [batch.column(0)[i].values, batch.column(1)[i].values, pa.array(n), pa.array(bits), pa.array(bits / n), pa.array(top.astype(np.int32)), pa.array(context / n)]
                yield pa.RecordBatch.from_arrays(cells, names=["h1", "h2", "n_words", "bits", "bits_per_word", "longest_match", "mean_context"])

    out = table.select("h1", "h2", "cell").mapInArrow(scored, "h1 long, h2 long, n_words long, bits double, bits_per_word double, longest_match int, mean_context double")
    return names.join(out, ["h1", "h2"], "left").select(F.col("id").alias("doc_id"), "key", F.coalesce("n_words", F.lit(0)).alias("n_words"), "bits", "bits_per_word", "longest_match", "mean_context")
