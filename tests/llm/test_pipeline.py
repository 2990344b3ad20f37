"""The corpus pipeline and its queries."""

import os
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_text_ops import SCHEMA, brute_groups, ppm_bits, texts
from tonelake.llm import bpe, langid, mixing

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.001"


def corpus():
    rows = []
    for lang, seed in (("aa", 1), ("bb", 2)):
        for i, t in enumerate(texts(70, seed, words=90)):
            rows.append((len(rows), t, lang, "uvw"[i % 3], len(t)))
            if i % 6 == 0:  # near copies
                w = t.split()
                w[3] = "changed"
                rows.append((len(rows), " ".join(w), lang, "u", 0))
            if i % 10 == 0:
                rows.append((len(rows), t.upper() + "!", None, "v", 0))
    rows += [(len(rows) + i, "".join(chr(33 + (i * 17 + j * 53) % 90) for j in range(150)), "aa", "u", 0) for i in range(4)]
    return [*rows, (None, None, None, None, None), (990, "", "aa", "u", 0)]


def brute(rows):
    """The stages in plain Python: rows kept by each, and the last one's ids."""
    def plain(t):
        return " ".join((t or "").lower().split()).encode()

    train = defaultdict(list)
    for r in rows:
        if r[2] and r[0] is not None and plain(r[1]):
            train[r[2]].append((r[0], plain(r[1])))
    assert all(len(t) <= 200 for t in train.values())
    model = {l: [t for _, t in ts] for l, ts in train.items()}
    kept = [r for r in rows if plain(r[1]) and min(ppm_bits(m, plain(r[1]), langid.ORDER) for m in model.values()) / len(plain(r[1])) <= langid.MOST_BITS]
    gone = {i for g in brute_groups([(r[0], r[1]) for r in kept], 0.5) for i in sorted(g)[1:]}
    single = [r for r in kept if r[0] not in gone]
    return kept, single


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(langid, "TRAIN_DOCS", 200)
    monkeypatch.setitem(langid.keep_identified.__kwdefaults__, "train_docs", 200)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs, out = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append({tuple(r) for r in docs.collect()})
    kept, single = brute(rows)
    assert out[0] == set(kept) and out[1] == set(single) and len(single) < len(kept) < len(rows)
    # the sample: of the documents before it, balanced in each source
    assert out[2] < out[1]
    tokens = defaultdict(int)
    for r in single:
        tokens[r[3]] += len(r[1].split())
    p = mixing.probabilities(tokens, {s: t**mixing.TEMPERATURE for s, t in tokens.items()}, mixing.FRACTION)
    for s in tokens:
        own = [r for r in out[2] if r[3] == s]
        before = [r for r in single if r[3] == s]
        assert abs(len(own) - p[s] * len(before)) <= 1.01 and abs(sum(len(r[1].split()) for r in own) - p[s] * tokens[s]) <= 2 * 90
    lib = Tokenizer.from_file(bpe.VOCABULARY)
    lib.encode_special_tokens = True
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {r[0]: r[1] for r in out[2]}
    assert {r.doc_id for r in final} == set(text) and all(r.decoded_ok and r.ids == lib.encode(text[r.doc_id], add_special_tokens=False).ids for r in final)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") or n == "pipeline"])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() >= (0 if name.startswith("op4") else 1)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["ann_all_cells", "warc_capture_summary", "mixing_units"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist())) and np.array_equal(columns, sorted(got.columns))


def test_entry_works_without_these_folders(tmp_path):
    for p in ("tonelake", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "tonelake/llm")], check=True)
    code = "import __spark_entry__ as e; assert 'message_score' in e.queries() and not any(q.startswith('op') for q in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
