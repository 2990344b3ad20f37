"""Language ID, MinHash, BPE, PFOR, n-gram scoring, mixing, sharding, WARC: against brute force, round trips and the defined cases."""

import gzip
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tonelake.llm import bpe, langid, minhash, mixing, ngram, pfor, sharding, warc
from tonelake.llm.common import connected_components
from tonelake.llm.queries import queries as corpus_queries
from tonelake.llm.words import word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "no id here at all", "en", "a", 1), (1, None, "en", None, 2), (2, "", "en", "a", 3), (3, " \n\t", None, "a", 4), (4, "!!! ...", "en", "b", 5), (5, "word " * 60_000, "en", "b", 6), (6, "the same row", "en", "a", 7), (6, "the same row", "en", "a", 7), (7, "日本語 😀 👩‍👩‍👧 é <|endoftext|> don't we'll", "xx", "c", 8)]


def odd(spark, schema=SCHEMA, rows=ODD):
    return spark.createDataFrame(rows, schema)


def clashing(df):
    """With columns of names that operators use themselves."""
    return df.withColumns({c: F.lit("x") for c in ("id", "key", "sig", "h", "r", "found", "place", "p", "order", "block", "size", "number", "group", "root", "node", "__id", "ids", "n_tokens", "selected", "keep", "accepted")})


def texts(n, seed, words=300, size=(30, 90)):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(words)]
    return [" ".join(rng.choice(vocab) for _ in range(rng.randint(*size))) for _ in range(n)]


# language ID


def ppm_bits(train, text, order):
    """PPM, method C, read off plainly."""
    counts = defaultdict(Counter)
    for t in train:
        for i in range(len(t)):
            for k in range(min(order, i) + 1):
                counts[t[i - k : i]][t[i]] += 1
    total = 0.0
    for i, c in enumerate(text):
        k = min(order, i)
        while k >= 0:
            seen = counts.get(text[i - k : i])
            if seen:
                n, d = sum(seen.values()), len(seen)
                if c in seen:
                    total += -math.log2(seen[c] / (n + d))
                    break
                total += -math.log2(d / (n + d))
            k -= 1
        else:
            total += 8
    return total


def test_ppm_bits():
    train = {"a": [b"abracadabra abra", b"cad"], "b": [b"hello yellow fellow"], "c": [b"x"]}
    model = langid.Ppm.train(train, 3)
    tests = [b"abra", b"yellow abracadabra", b"", b"\xffz\x00", b"c", b"ca", b"cad", b"hel" * 40]
    raw, at = np.frombuffer(b"".join(tests), np.uint8), np.cumsum([0, *map(len, tests)])
    got = model.bits(raw, at)
    for i, t in enumerate(tests):
        for j, l in enumerate(sorted(train)):
            assert got[i, j] == pytest.approx(ppm_bits(train[l], t, 3), rel=1e-5, abs=1e-6), (t, l)


def test_language_held_out(spark):
    rows, k = [], 0
    for lang, seed in (("aa", 1), ("bb", 2), ("cc", 3)):
        for t in texts(120, seed, words=80):
            rows.append((k, t, lang, "s", 0))
            k += 1
    rows += [(k + i, "".join(chr(33 + (i * 7 + j * 31) % 90) for j in range(200)), "aa", "s", 0) for i in range(3)]
    docs = odd(spark, rows=rows)
    model = langid.train(docs.where(f"doc_id % 2 = 0 and doc_id < {k}"))
    got = langid.identify(docs.where(f"doc_id % 2 = 1 or doc_id >= {k}"), model=model).collect()
    held = [r for r in got if r.doc_id < k]
    assert sum(r.pred_lang == r.lang for r in held) >= 0.98 * len(held) and all(r.accepted for r in held)
    kept = langid.keep_identified(docs, model=model)
    assert kept.columns == docs.columns and kept.count() == len(held) * 2


def test_language_cases(spark):
    docs = clashing(odd(spark))
    rows = langid.identify(docs).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i in (1, 2, 3):
        assert by[i][0].pred_lang is None and not by[i][0].accepted and by[i][0].bits_per_byte is None
    assert by[6][0] == by[6][1] and by[5][0].pred_lang == "en"
    assert langid.keep_identified(docs).columns == docs.columns
    assert langid.identify(odd(spark, rows=[])).count() == 0
    none = langid.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert not any(r.accepted for r in none) and all(r.pred_lang is None for r in none)


# MinHash


def shingles(text):
    w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} or {tuple(w)} if w else set()


def planted(seed=3):
    rng, rows = random.Random(seed), []
    for g, base in enumerate(texts(60, seed)):
        rows.append((len(rows), base))
        w = base.split()
        for _ in range(g % 5):
            v = list(w)
            for _ in range(max(1, len(v) // 25)):
                v[rng.randrange(len(v))] = "new" + str(rng.randrange(999))
            rows.append((len(rows), " ".join(v).capitalize() + "!"))
    return rows


def brute_groups(rows, threshold):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    groups = defaultdict(set)
    for i in range(len(rows)):
        groups[find(i)].add(rows[i][0])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_minhash_against_brute_force(spark):
    rows = planted()
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r.group_id].add(r.doc_id)
    assert {frozenset(g) for g in groups.values()} == brute_groups(rows, 0.5)
    assert all(r.group_id == min(groups[r.group_id]) and r.group_size == len(groups[r.group_id]) and r.keep == (r.doc_id == r.group_id) for r in got)


def test_minhash_large_group_and_copies(spark):
    base = texts(1, 9, size=(120, 121))[0].split()
    rows = []
    for i in range(400):  # a crowded region: it is split, and nothing is cut off
        v = list(base)
        v[i % 120] = f"w{i}"
        rows.append((i, " ".join(v)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 700 and {r.group_id for r in got} == {0}
    assert minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect() == [(0, rows[0][1])]


def test_minhash_cases(spark):
    docs = clashing(odd(spark, rows=[*ODD, (8, "THE same, row!", "en", "a", 1), (9, "", "en", "a", 1), (9, "other words altogether", "en", "a", 1), (9, "again some more words", "en", "a", 1)]))
    got = minhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.group_id, r.group_size, r.n_links, r.keep) for r in got} == {(6, 6, 2, 0, True), (8, 6, 2, 0, False)}
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({None: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 3})
    empty = odd(spark, rows=[])
    assert minhash.near_duplicates(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 200)]
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + chain + [(500, 500), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    root = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(300):
        for a, b in edges:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


# BPE and PFOR

VOCAB = bpe.VOCABULARY
TRICKY = [
    "", " ", "  ", "a", " a", "a  b", "don't  they'll I'VE 's 'll've ''s x's", "\n\n a\n", "tab\t\tx ", "１２ ½ ² 12a", "é ́", "😀👩‍👩‍👧", "日本語テキスト", "<|endoftext|>x<|endoftext|>", "   x", "​﻿z", "a" * 3000, "!?#$%^&*()" * 5, "مرحبا بالعالم", "\x00\x01\x7f", "ßẞİ", "'re",
    "don'", "'", "x '", "'s", "\u0085 a", "a b",
]


def test_bpe_equals_the_library(spark):
    lib = Tokenizer.from_file(VOCAB)
    lib.encode_special_tokens = True
    rng = random.Random(4)
    alphabet = "ab 1'\n\t!é日😀st ."
    cases = TRICKY + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = bpe.encode(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").repartition(3)).collect()
    assert len(rows) == len(cases)
    for r in rows:
        e = lib.encode(cases[r.doc_id], add_special_tokens=False)
        assert r.ids == e.ids, cases[r.doc_id]
        assert r.decoded_ok and r.n_tokens == len(e.ids)
        spans = list(zip(r.starts, r.ends, strict=True))
        data = cases[r.doc_id].encode()
        at, t = 0, bpe.tokenizer(VOCAB)
        for i, (a, b) in zip(r.ids, spans, strict=True):  # by the definition, from bytes
            size = int(t.size[i])
            chars = [len(data[:x].decode("utf-8", "ignore")) for x in (at + 1, at + size)]
            # a span begins at the character of its first byte, and ends after that of its last
            whole = (data[at + size : at + size + 1] or b"a")[0] & 0xC0 != 0x80
            assert b == chars[1] + (0 if whole else 1) and 0 <= a < b
            assert data[at : at + size] in cases[r.doc_id][a:b].encode()
            at += size


def test_bpe_cases(spark):
    rows = bpe.encode(clashing(odd(spark))).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ODD) and by[1].ids is None and by[1].n_tokens is None and by[2].ids == [] and by[5].decoded_ok and by[7].decoded_ok
    back = spark.createDataFrame([([30433, 222],), ([],), (None,), ([128],)], "ids array<int>").select(bpe.decode_column(F.col("ids")).alias("t")).collect()
    assert back[1].t == "" and back[2].t is None and "�" in back[3].t
    with pytest.raises(Exception, match="not in the vocabulary"):
        spark.createDataFrame([([999_999],)], "ids array<int>").select(bpe.decode_column(F.col("ids"))).collect()
    assert bpe.encode(odd(spark, rows=[])).count() == 0


@pytest.mark.parametrize("block", [1, 3, 64, 512])
def test_pfor_round_trip(block):
    rng = np.random.default_rng(block)
    docs = [rng.integers(0, 50_000, n) for n in (0, 1, 5, 512, 513, 2000)] + [np.full(700, 9), np.array([0, 2**32 - 1] * 300), np.r_[np.arange(500), [4_000_000_000]]]
    counts = np.array([len(d) for d in docs])
    data, size, starts, blocks = pfor.pack(np.concatenate(docs).astype(np.int64), counts, block)
    at, b = np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(blocks)]
    for i, d in enumerate(docs):
        own, s = data[at[i] : at[i + 1]].tobytes(), starts[b[i] : b[i + 1]]
        assert pfor.unpack(own, s).tolist() == d.tolist()
        for j in range(len(s)):  # any block is read alone
            assert pfor.unpack_block(own, int(s[j])).tolist() == d[j * block : (j + 1) * block].tolist()


def test_pfor_cases(spark):
    docs = clashing(odd(spark))
    got = pfor.tokenize_and_pack(docs)
    want = {(r.doc_id, tuple(r.ids) if r.ids is not None else None) for r in bpe.encode(docs).collect()}
    rows = got.withColumn("back", pfor.unpack_column(F.col("blocks"), F.col("block_starts"))).collect()
    assert len(rows) == len(ODD) and {(r.doc_id, tuple(r.back) if r.back is not None else None) for r in rows} == want
    packed = spark.createDataFrame([(None,), ([],), ([7],)], "ids array<long>").select(pfor.pack_column(F.col("ids")).alias("p")).collect()
    assert packed[0].p is None and packed[1].p.n_tokens == 0 and packed[2].p.n_tokens == 1
    for bad in ([-1], [2**32], [None]):
        with pytest.raises(Exception, match="null or not in"):
            spark.createDataFrame([(bad,)], "ids array<long>").select(pfor.pack_column(F.col("ids"))).collect()
    assert pfor.tokenize_and_pack(odd(spark, rows=[])).count() == 0


# words


def test_words_by_unicode_class():
    say = ["dash—“quoted” no\u00a0break", "dash quoted no break", "今天，天气", "今 天 天 气", "été ไทย", "été ไ ท ย", "a€b", "a € b", "naïve", "かな。カナ", "か な カ ナ"]
    words, counts = word_hashes(pa.array(say))
    each = [w.tolist() for w in np.split(words, np.cumsum(counts)[:-1])]
    assert [len(w) for w in each] == [4, 4, 4, 4, 4, 4, 3, 3, 1, 4, 4]
    assert each[0] == each[1] and each[2] == each[3] and each[4] == each[5] and each[6] == each[7] and each[9] == each[10]


def test_minhash_chinese_near_copy(spark):
    rng = random.Random(3)
    a = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200))
    b = a[:100] + "龍" + a[101:]
    other = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(200))
    docs = spark.createDataFrame([(1, a), (2, b), (3, other)], "doc_id long, text string")
    groups = defaultdict(set)
    for row in minhash.near_duplicates(docs).collect():
        groups[row.group_id].add(row.doc_id)
    assert {1, 2} in groups.values()


# n-gram scoring


def words_of(t):
    return "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()


def brute_bits(query, corpus, prior, vocabulary):
    docs = [[*words_of(t), "\0"] for t in corpus if words_of(t)]
    count = Counter(tuple(d[i:j]) for d in docs for i in range(len(d)) for j in range(i + 1, len(d) + 1))
    total, q, bits, longest = sum(map(len, docs)), words_of(query), 0.0, 0
    contexts = 0
    for i in range(len(q)):
        p = (count[(q[i],)] + prior / vocabulary) / (total + prior)
        n = next(n for n in range(i, -1, -1) if not n or count[tuple(q[i - n : i])])  # the longest context that is there
        if n:
            h = tuple(q[i - n : i])
            p = (count[(*h, q[i])] + prior * p) / (count[h] + prior)
        contexts += n
        longest = max(longest, next(n for n in range(i + 1, -1, -1) if not n or count[tuple(q[i + 1 - n : i + 1])]))
        bits -= math.log2(p)
    return (len(q), bits, longest, contexts / len(q)) if q else (0, None, None, None)


@pytest.mark.parametrize("shard_words", [1, 50, 1 << 20])
def test_ngram_against_brute_force(spark, shard_words):
    corpus = texts(40, 5, words=12, size=(1, 25)) + [None, "", "?!", "a b a b a b", "a b a b a b"]
    queries = texts(8, 5, words=12, size=(1, 20)) + ["a b a b a b a b", "unseen thing", "", None, "..."]
    docs = clashing(spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string").repartition(3))
    got = {r.item_id: r for r in ngram.score(spark.createDataFrame(list(enumerate(queries)), "item_id long, text string"), docs, shard_words=shard_words).collect()}
    assert len(got) == len(queries)
    for i, q in enumerate(queries):
        n, bits, longest, mean = brute_bits(q, corpus, ngram.PRIOR, ngram.VOCABULARY_SIZE)
        assert (got[i].n_words, got[i].longest_match, got[i].mean_context) == (n, longest, None if mean is None else pytest.approx(mean))
        assert got[i].bits == (None if bits is None else pytest.approx(bits, rel=1e-9))


def test_ngram_cases(spark):
    q = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "item_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert {(r.item_id, round(r.bits, 6)) for r in ngram.score(q, empty).collect()} == {(1, 40.0), (None, 20.0)}
    assert ngram.score(q.limit(0), spark.createDataFrame([(1, "a b")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        ngram.score(q, empty, most_query_bytes=1)


@pytest.mark.parametrize(("block_words", "range_asks"), [(40, 100), (1 << 21, 1 << 22), (300, 1 << 22)])
def test_every_document_is_scored(spark, block_words, range_asks):
    rng = random.Random(2)
    long = " ".join(texts(1, 9, words=40, size=(70, 71)))
    near = [" ".join(w if rng.random() > 0.06 else "zz" for w in long.split()) for _ in range(9)]  # counts change at many lengths
    corpus = texts(30, 5, words=12, size=(1, 25)) + [None, "", "?!", "a b a b a b", "a b a b a b", "A B a b A b", "b a b a", "only here only here", long, "x " + long, long + " y z", long[: len(long) // 2], *near]
    docs = clashing(spark.createDataFrame([*enumerate(corpus), (0, corpus[0])], "doc_id long, text string").repartition(3))
    rows = ngram.score_documents(docs, block_words=block_words, range_asks=range_asks).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(got) == len(corpus)  # a repeated row is one document
    for i, t in enumerate(corpus):
        n, bits, longest, mean = brute_bits(t, corpus[:i] + corpus[i + 1 :], ngram.PRIOR, ngram.VOCABULARY_SIZE)  # its own text doesn't count, its copies do
        assert got[i].n_words == n
        assert (got[i].bits, got[i].longest_match, got[i].mean_context) == ((pytest.approx(bits), longest, pytest.approx(mean)) if n else (None, None, None))


def test_scored_documents_odd_rows(spark):
    assert ngram.score_documents(odd(spark).limit(0)).count() == 0
    got = {(r.doc_id, r.n_words) for r in ngram.score_documents(clashing(odd(spark))).collect()}
    assert got >= {(None, 5), (1, 0), (2, 0), (3, 0), (4, 0), (5, 60_000), (6, 3)} and len(got) == 8
    alone = ngram.score_documents(odd(spark, rows=[(1, "by itself", "en", "a", 1)])).collect()[0]
    assert alone.bits == pytest.approx(40) and alone.longest_match == 0  # uniform: nothing is known


def test_places_that_follow_are_not_searched():
    rng = random.Random(4)
    long = [f"w{i}" for i in range(100)] + ["again and again"] * 4
    corpus = [" ".join(w if rng.random() > 0.02 else "zz" for w in long) for _ in range(4)] + ["w1 w2 w3 zz w5", "again and again and again"]
    words, n = word_hashes(pa.array(corpus))
    vocab, word = np.unique(words, return_inverse=True)
    total = int((n + 1).sum())
    deep = ngram.begin({"n": n, "weight": np.ones(len(n), np.int64), "vocab": vocab, "word": word.astype(np.int32)}, 1, {}, total, ngram.PRIOR, ngram.VOCABULARY_SIZE)
    asked = steps = 0
    while len(deep.place):
        deep.settle(total, ngram.PRIOR, ngram.VOCABULARY_SIZE)
        deep, steps = ngram.Deep(ngram.unpack(deep.state())), steps + 1
        asked += len(deep.ask) if steps > 2 else 0
        deep.answer(deep.asks.totals(1, {}))
    deep.settle(total, ngram.PRIOR, ngram.VOCABULARY_SIZE)
    for i, t in enumerate(corpus):
        count, bits, longest, mean = brute_bits(t, corpus[:i] + corpus[i + 1 :], ngram.PRIOR, ngram.VOCABULARY_SIZE)
        assert (n[i], deep.s["top"][i]) == (count, longest)
        assert (deep.s["bits"][i], deep.s["context"][i] / n[i]) == (pytest.approx(bits), pytest.approx(mean))
    assert asked < len(words) / 2


def test_states_stay_where_they_are(spark, monkeypatch):
    plans, rows, own, real = [], [], [], ngram.written

    def seen(df, what, **by):
        table = real(df, what, **by)
        own.append(ngram.path_of(table))
        if what == "state":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            rows.append((table.count(), table.select("block").distinct().count()))
        return table

    monkeypatch.setattr(ngram, "written", seen)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts(40, 5, words=12, size=(20, 40)) + ["a b c d e f g h i j", "a b c d e f g h i j k"])], "doc_id long, text string")
    assert ngram.score_documents(docs, block_words=100, range_asks=1000).count() == 42
    assert len(plans) > 2
    assert all(p.count("Exchange hashpartitioning(block") == 1 for p in plans)  # of the answers; the states aren't shuffled
    assert all(n == blocks > 1 for n, blocks in rows)  # nor are lists written beside them
    ngram.drop_written(spark, own)
    assert not {t.name for t in spark.catalog.listTables()} & {p.rsplit("/", 1)[1].replace("-", "_") for p in own}


def test_op3_scores_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_queries()["op3_ngram_scoring"](spark, "/root/testdata/sf0.001")
    assert {r[0] for r in got.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_suffix_array():
    rng = np.random.default_rng(2)
    tokens = rng.integers(1, 3, 300).astype(np.uint64)
    stop = np.array([50, 51, 200, 299])
    tokens[stop] = 0
    order = ngram.suffix_array(tokens, stop)
    ends = {p: i for i, p in enumerate(stop.tolist())}

    def suffix(p):
        e = next(x for x in stop.tolist() if x >= p)
        return [(1, int(t)) for t in tokens[p:e]] + [(0, ends[e])]

    assert [suffix(p) for p in order.tolist()] == sorted(suffix(p) for p in range(300))


def thue_morse(n):
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse():
    for n in (1024, 2048, 4096):
        h, counts = word_hashes(pa.array([*thue_morse(n), "x" + thue_morse(n)[0]]))
        assert counts.tolist() == [1, 1, 1] and len(set(h.tolist())) == 3
    h, _ = word_hashes(pa.array(["abcdefgh abcdefgha abcdefghA a b aa abcdefgh"]))
    assert h[0] == h[6] and h[1] == h[2] and len(set(h.tolist())) == 5


def test_pre_tokens_that_polynomial_hashes_confuse():
    from tokenizers import Tokenizer

    rng = random.Random(3)
    own, library = bpe.ByteBpe(bpe.VOCABULARY), Tokenizer.from_file(bpe.VOCABULARY)
    say = [*thue_morse(2048), " ".join(thue_morse(4096)), *("".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(300))]
    for part in (say, say[::-1]):  # in one batch, and beside what the first batch left
        ids, starts, ends, n = own.encode(pa.array(part))
        assert own.decode(ids, n).to_pylist() == part
        at = np.cumsum(n) - n
        for i, x in enumerate(part):
            want = library.encode(x)
            assert ids[at[i] : at[i] + n[i]].tolist() == want.ids
            assert list(zip(starts[at[i] : at[i] + n[i]].tolist(), ends[at[i] : at[i] + n[i]].tolist(), strict=True)) == want.offsets


def test_colliding_hashes_give_right_ids(monkeypatch):
    monkeypatch.setattr(bpe, "slice_hashes", lambda eight, start, end: np.zeros(len(start), np.uint64))
    own = bpe.ByteBpe(bpe.VOCABULARY)
    say = ["one two", "two one", "", "three"]
    ids, _, _, n = own.encode(pa.array(say))
    assert own.decode(ids, n).to_pylist() == say


def test_other_vocabulary_files_are_refused(tmp_path):
    import json

    file = json.loads(open(bpe.VOCABULARY).read())
    for change in ({"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "Lowercase"}}):
        (tmp_path / "v.json").write_text(json.dumps(file | change))
        with pytest.raises(ValueError):
            bpe.ByteBpe(str(tmp_path / "v.json"))


# mixing


def test_flight_keeps_its_constraints():
    rng = np.random.default_rng(8)
    p, tokens = rng.random(200).tolist(), rng.integers(0, 90, 200).astype(float).tolist()
    out = mixing.flight(p, tokens, rng.random)
    assert sum(0 < x < 1 for x in out) <= 2
    assert sum(out) == pytest.approx(sum(p), abs=1e-4) and np.dot(out, tokens) == pytest.approx(np.dot(p, tokens), abs=1e-2)


def test_flight_is_fair():
    p, tokens = [0.3, 0.5, 0.7, 0.2, 0.3], [1.0, 5.0, 2.0, 8.0, 3.0]
    mean = np.mean([mixing.flight(p, tokens, np.random.default_rng(i).random) for i in range(6000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_mixing_balances(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 60), "en", rng.choice("aaab"), 0) for i in range(3000)]
    docs = odd(spark, rows=rows)
    got = mixing.mix_sources(docs, weights={"a": 1, "b": 1, "zz": 5}, fraction=0.3, block=200).collect()
    tokens = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
    p = mixing.probabilities(tokens, {"a": 1, "b": 1, "zz": 5}, 0.3)
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert all(r.inclusion == pytest.approx(p[s]) for r in own)
        assert abs(sum(r.selected for r in own) - p[s] * len(own)) <= 1.01
        assert abs(sum(r.n_tokens for r in own if r.selected) - p[s] * tokens[s]) <= 121  # two landings of the longest
    again = mixing.mix_sources(docs.repartition(7), weights={"a": 1, "b": 1}, fraction=0.3, block=200).collect()
    assert {r.doc_id for r in again if r.selected} == {r.doc_id for r in got if r.selected}
    assert p["a"] * tokens["a"] == pytest.approx(p["b"] * tokens["b"])
    kept = mixing.keep_mixed(docs, weights={"a": 1, "b": 1}, fraction=0.3, block=200)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.selected}


def test_mixing_cases(spark):
    docs = clashing(odd(spark))
    rows = mixing.mix_sources(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter({None: 1, **dict.fromkeys(range(1, 8), 1)})
    by = {r.doc_id: r for r in rows}
    assert by[1].n_tokens == 0 and by[1].source is None and by[1].inclusion == 0 and by[6].n_tokens == 6
    kept = mixing.keep_mixed(docs, fraction=1.0)
    assert kept.columns == docs.columns and kept.count() == len(ODD) - 1  # a source without tokens is not sampled
    assert mixing.mix_sources(odd(spark, rows=[])).count() == 0 and mixing.keep_mixed(odd(spark, rows=[])).count() == 0


def test_source_plan_is_that_of_probabilities(spark):
    rng = random.Random(4)
    sizes = {None: 40, "none": 0, **{f"s{i}": int(10 ** rng.uniform(0, 4)) for i in range(60)}}
    units = spark.createDataFrame([(s, t // 2) for s, t in sizes.items()] + [(s, t - t // 2) for s, t in sizes.items()], "source string, n_tokens long")
    for weights, fraction in ((None, 0.5), (None, 1.0), ({s: rng.random() for s in [*list(sizes)[:50], "absent"]}, 0.3), ({"s1": 1.0}, 0.9), ({}, 0.5)):
        plan, most = mixing.source_plan(units, weights, fraction, 0.5)
        want = mixing.probabilities(sizes, {s: t**0.5 for s, t in sizes.items() if t} if weights is None else weights, fraction)
        assert {r.source: r.inclusion for r in plan.collect()} == {s: pytest.approx(p, abs=1e-12) for s, p in want.items()} and most == 2


def test_small_blocks(spark):
    docs = odd(spark, rows=[(i, "w " * (i % 7 + 1), "en", "a", 0) for i in range(40)])
    for block in (1, 2, 3):
        with pytest.raises(ValueError):
            mixing.mix_sources(docs, block=block)
    assert sum(r.selected for r in mixing.mix_sources(docs, block=4).collect()) in (19, 20, 21)


# sharding


def test_shards_are_even_and_in_order(spark):
    rng = random.Random(2)
    rows = [(i, "x" * int(rng.paretovariate(1.2) * 50 % 4000), "en", rng.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(4000)]
    rows += [(5000, "y" * 90_000, "en", "b", 1), (5001, "", "en", "hot", 2), (5001, "z" * 30_000, "en", "hot", 2), (5001, "z" * 30_000, "en", "hot", 2)]
    docs, target = odd(spark, rows=rows), 20_000
    got = sharding.shard(docs, target_bytes=target)
    out = got.withColumn("part", F.spark_partition_id()).collect()
    assert Counter(tuple(r)[:5] for r in out) == Counter(rows)
    size, spans, parts = Counter(), defaultdict(list), defaultdict(set)
    for r in out:
        size[r.shard] += len(r.text)
        spans[r.shard].append((r.source or "", r.doc_id))
        parts[r.shard].add(r.part)
    assert all(len(p) == 1 for p in parts.values())
    order = sorted(spans)
    assert all(max(spans[a]) < min(spans[b]) for a, b in itertools.pairwise(order))
    over = [s for s in order if size[s] > sharding.MOST * target]
    assert all(len(set(spans[s])) == 1 for s in over), [(size[s], len(set(spans[s]))) for s in over]


def test_shard_cases(spark):
    docs = clashing(odd(spark))
    got = sharding.shard(docs, target_bytes=1000)
    assert got.columns == [*docs.columns, "shard"] and got.count() == len(ODD)
    assert len({r.shard for r in got.where("doc_id = 6").collect()}) == 1
    assert sharding.shard(odd(spark, rows=[])).count() == 0
    with pytest.raises(TypeError):
        sharding.shard(docs.withColumn("source", F.lit(1.5)))
    numbers = odd(spark, rows=[(i, "x" * 100, "en", "a", (-1) ** i * i) for i in range(300)])
    rows = sorted(sharding.shard(numbers, key="n_chars", target_bytes=3000).collect(), key=lambda r: r.n_chars)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows) and rows[-1].shard >= 7


# WARC


def record(kind, name, *to, body="b", **more):
    lines = [f"WARC/1.0\r\nWARC-Type: {kind}", *([f"WARC-Record-ID: {name}"] if name else []), *(f"WARC-Concurrent-To: {t}" for t in to), *(f"{k}: {v}" for k, v in more.items())]
    return "\r\n".join(lines) + f"\r\nContent-Length: {len(body.encode())}\r\n\r\n" + body


RECORDS = [
    record("response", "<r1>", body="HTTP/1.1 200 OK\r\n\r\nhéllo\r\n\r\nx", **{"WARC-Target-URI": "http://a/"}), record("request", "<q1>", "<r1>"), record("metadata", "<m1>", "<q1>"), record("metadata", "<m2>", "<gone>", body="1"),
    record("request", "<q2>", "<gone>"), record("warcinfo", "<w>"), record("revisit", "<r3>", "<q3>", "<m3>"), record("request", "<q3>"), record("metadata", "<m3>"), record("response", "", body="no id"), "garbage", "",
]


def test_warc_captures(spark):
    rows = [(r,) for r in RECORDS] + [(RECORDS[0],), (None,)]
    got = {r.capture_id: r for r in warc.assemble(warc.parse_records(clashing(spark.createDataFrame(rows, "raw string")))).collect()}
    names = lambda c: tuple(tuple(x.record_id for x in c[k]) for k in ("requests", "responses", "metadata", "others"))
    assert names(got["<r1>"]) == (("<q1>",), ("<r1>",), ("<m1>",), ()) and got["<r1>"].target_uri == "http://a/"
    assert names(got["<m2>"]) == (("<q2>",), (), ("<m2>",), ()) and names(got["<r3>"]) == (("<q3>",), ("<r3>",), ("<m3>",), ()) and names(got["<w>"]) == ((), (), (), ("<w>",))
    assert len(got) == 7 and sum(k.startswith("<hash:") for k in got) == 3
    assert got["<r1>"].responses[0].payload.endswith("héllo\r\n\r\nx")
    assert warc.assemble(warc.parse_records(spark.createDataFrame([], "raw string"))).count() == 0


def test_warc_files(spark, tmp_path):
    whole = [r for r in RECORDS if r.startswith("WARC") and "<" in r]
    (tmp_path / "a.warc").write_bytes(b"\r\n\r\n".join(r.encode() for r in whole) + b"\r\n\r\n")
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r.encode() + b"\r\n\r\n") for r in whole))
    for name in ("a.warc", "b.warc.gz"):
        rows = warc.read_warc(spark, str(tmp_path / name)).collect()
        direct = warc.parse_records(spark.createDataFrame([(r,) for r in whole], "raw string")).collect()
        assert sorted((r.record_id, r.type, r.payload) for r in rows) == sorted((r.record_id, r.type, r.payload) for r in direct)


def test_warc_payload_bytes(spark, tmp_path):
    bodies = [b"caf\xe9 \x00", b"caf\xe8 \x00", "café".encode()]
    record = lambda b: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(b), b)
    (tmp_path / "a.warc").write_bytes(b"".join(map(record, bodies)))
    (one,) = warc.assemble(warc.read_warc(spark, str(tmp_path))).collect()
    assert sorted(bytes(r.payload_bytes) if r.payload_bytes is not None else r.payload.encode() for r in one.responses) == sorted(bodies)


def test_warc_pages(spark):
    pages = clashing(spark.createDataFrame([(1, "http://h/p?q#f", "<p>é</p>"), (2, None, None), (None, "https://x", "")], "page_id long, url string, html string"))
    got = {r.capture_id: r for r in warc.capture_summary(warc.assemble(warc.parse_records(warc.records_of_pages(pages)))).collect()}
    a = got["<urn:page:response:1>"]
    assert (a.n_requests, a.n_responses, a.n_metadata, a.status, a.body_chars, a.path) == (1, 1, 1, 200, 8, "/p?q") and len(got) == 3


def test_tiny_arrow_batches():
    assert minhash.signatures(pa.array([], pa.string()))[0].shape == (0, minhash.PERMS)
    assert minhash.signatures(pa.array([None, ""], pa.string()))[1].tolist() == [False, False]


@pytest.mark.parametrize("seed", [1, 2])
def test_no_range_stays_overfull(spark, seed):
    """Sizes, ties and a sample that is far too small: still no range over the limit holds two records that could be apart."""
    rng = random.Random(seed)
    texts_ = [(i // 3, rng.choice(["", "x", "y" * 40, "z" * 900, "w" * 260]), "en", rng.choice(["a", "a", "b", None]), 0) for i in range(600)]
    docs = odd(spark, rows=[*texts_, *([(77, "same " * 60, "en", "a", 0)] * 9)])
    target = 300
    got = sharding.shard(docs, target_bytes=target, oversample=1, seed=seed).collect()
    assert len(got) == 609
    held = {}
    for r in got:
        held.setdefault(r.shard, Counter())[r.source, r.doc_id] += len(r.text)
    assert all(sum(c.values()) <= sharding.MOST * target or len([x for x in c.values() if x]) == 1 for c in held.values())
    order = sorted(held)
    key = lambda k: (k[0] is not None, k[0] or "", k[1])
    assert all(max(map(key, held[x])) < min(map(key, held[y])) for x, y in zip(order, order[1:], strict=False))


def test_first_splitters_do_not_depend_on_partitions(spark):
    docs = odd(spark, rows=[(i, "w" * (i * 37 % 101), "en", "ab"[i % 2], 0) for i in range(900)])
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sharding.splitters(docs, target_bytes=2000))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_automaton_has_a_limit():
    texts_ = {"x": [bytes(range(256)) * 2]}
    with pytest.raises(ValueError):
        langid.Ppm.train(texts_, order=4)
    assert langid.Ppm.train(texts_, order=3).langs == ["x"]


def brute_pack(ids, block, percentile):
    """The layout of the module's docstring, value by value."""
    out, starts = b"", []
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        least = min(part)
        rest = [x - least for x in part]
        w = next(w for w in range(33) if sum(x < 1 << w for x in rest) >= math.ceil(percentile * len(rest)))
        over = [(k, x >> w) for k, x in enumerate(rest) if x >> w]
        bits = sum((x & ((1 << w) - 1)) << (k * w) for k, x in enumerate(rest))
        starts.append(len(out))
        out += len(part).to_bytes(2, "little") + bytes([w, 0]) + least.to_bytes(4, "little") + len(over).to_bytes(2, "little")
        out += b"".join(k.to_bytes(2, "little") for k, _ in over) + b"".join(h.to_bytes(4, "little") for _, h in over) + bits.to_bytes((len(part) * w + 7) // 8, "little")
    return out, starts


def test_op9_against_brute_force(spark):
    """Every packed document of the registered query, byte for byte."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.VOCABULARY)
    library.encode_special_tokens = True
    texts_ = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = corpus_queries()["op9_pfor_tokens"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == set(texts_)
    for r in rows:
        ids = library.encode(texts_[r.doc_id]).ids
        assert (bytes(r.blocks), r.block_starts, r.n_tokens) == (*brute_pack(ids, pfor.BLOCK, pfor.PERCENTILE), len(ids))


def test_pack_against_brute_force():
    rng = random.Random(8)
    lists_ = [[rng.choice([rng.randrange(20), rng.randrange(5000), 2**32 - 1]) for _ in range(n)] for n in (1, 7, 8, 9, 16, 100, 3, 31)] + [[5] * 20, []]
    flat, n = np.array([x for l in lists_ for x in l], np.int64), np.array([len(l) for l in lists_])
    for block, percentile in ((8, 0.95), (8, 0.5), (16, 1.0), (300, 0.9)):
        data, size, starts, blocks = pfor.pack(flat, n, block, percentile)
        want = [brute_pack(l, block, percentile) for l in lists_]
        assert data.tobytes() == b"".join(d for d, _ in want) and size.tolist() == [len(d) for d, _ in want]
        assert starts.tolist() == [s for _, own in want for s in own] and blocks.tolist() == [len(own) for _, own in want]


def test_assembly_against_brute_force(spark):
    """Random names as concurrent, among them absent ones, chains and cycles: captures are the components."""
    rng = random.Random(6)
    kinds = ["request", "response", "metadata", "revisit", "resource", None]
    rows = [(f"r{i:03}", rng.choice(kinds), f"u{i}", "d", [f"r{rng.randrange(150):03}" for _ in range(rng.choice([0, 0, 1, 1, 2]))], "h", f"p{i % 9}") for i in range(120)]
    root = {f"r{i:03}": f"r{i:03}" for i in range(150)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in rows:
        for to in r[4]:
            root[find(to)] = find(r[0])
    want = defaultdict(lambda: defaultdict(set))
    for r in rows:
        part = {"request": "requests", "metadata": "metadata", "response": "responses", "revisit": "responses"}.get(r[1], "others")
        want[find(r[0])][part].add((r[0], r[5], r[6]))
    got = warc.assemble(spark.createDataFrame(rows, warc.RECORD)).collect()
    names = ("requests", "responses", "metadata", "others")
    assert sorted(tuple(sorted((n, tuple(tuple(x) for x in r[n])) for n in names)) for r in got) == sorted(tuple(sorted((n, tuple(sorted(w[n]))) for n in names)) for w in want.values())
    heads = {min(w["responses"] or set().union(*w.values()))[0] for w in want.values()}
    assert {r.capture_id for r in got} == heads
