import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tonelake.plans import oracle, queries
from tonelake.streaming.sessions import live_scores, live_sessions

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def rows(df):
    """Sorted values, floats to 9 places."""
    flat = lambda x: None if x is None or x != x else round(float(x), 9) if isinstance(x, float) else x
    return sorted((tuple(flat(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    assert rows(entry.queries()[name](spark, DATA).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(oracle.oracle_sql())))
def test_without_sql(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_zh_score(spark):
    assert {r.score for r in queries.zh_score(spark, DATA).where("array_contains(expressions, '滚蛋')").collect()} <= {-1.0, -1.1, -1.2}


def test_entry(spark):
    assert entry.entry(spark).columns == ["conv_id", "turn", "score", "intensity"]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    talk = spark.createDataFrame([("u", "2026-01-01 00:00:00", "bad"), ("u", "2026-01-01 00:05:00", "good"), ("u", "2026-01-01 03:00:00", "ok"), ("u", "2026-01-02 03:00:00", "later")], "user string, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    talk.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(talk.schema).parquet(str(tmp_path / "in"))
    q = live_sessions(live_scores(stream), "user", "ts").writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.n_messages, r.mean_score) for r in spark.table("live").orderBy("start").collect()]
    assert got == [(2, 0.0), (1, 0.0)]


@pytest.mark.parametrize("name", ["topic_hist", "claude_counters", "codex_counters"])
def test_topics_beside_other_letters(spark, tmp_path, name):
    """Words beside letters that aren't ASCII, digits, marks and an underscore: the topics are those of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    texts = [a + w + b for w in ("test", "python", "blog", "Claude", "tmux", "swift") for a in ("", "ü", "é ", "x", "_", "7", "ß") for b in ("", "ä", " ö", "s", "_", "٣", "́")]
    talk = [(i, 0, "user", t) for i, t in enumerate(texts)] + [(i, 1, "system", t) for i, t in enumerate(texts)] + [(i, 2, "assistant", t) for i, t in enumerate(texts)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert rows(entry.queries()[name](spark, str(tmp_path)).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())
