import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tonelake.operators import coverage, extract, fixtures, mining, models, usage
from tonelake.operators.wordpiece import WordPiece, encode
from tonelake.sources import logs, sinks


def dump(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows))


def user(text, **more):
    return {"type": "user", "sessionId": "s1", "timestamp": "2026-01-02T03:04:05Z", "cwd": "/w/code/app", "message": {"role": "user", "content": text}} | more


@pytest.fixture(scope="module")
def claude_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("claude")
    answer = {"type": "assistant", "cwd": "/w/code/app", "message": {"role": "assistant", "model": "m", "content": [{"type": "tool_use"}, {"type": "text"}], "usage": {"input_tokens": 3, "output_tokens": None}}}
    dump(root / "p1/s1.jsonl", [
        user("hola, esto es una prueba de blog"), user([{"type": "tool_result"}]), user("meta message here", isMeta=True), {"type": "queue-operation", "operation": "enqueue", "content": "queued text please thanks", "timestamp": "2026-01-02T05:00:00Z"},
        {"type": "queue-operation", "operation": "remove", "content": "removed text"}, user("<task-notification> x y z"), user("/clear all of it"), user("short"), "{broken", "", "[1, 2]", answer, {"type": "system", "subtype": "turn_duration", "durationMs": 1500}, user("[\"a list in a string\"]"),
        user("see https://Ex.org:80/a?b and http://y.z\ttab"),
    ])
    dump(root / "p1/s2.jsonl", [user("the other file with this", cwd="/else", sessionId="s2")])
    dump(root / "p1/subagents/s9.jsonl", [user("never read this text")])
    dump(root / "p2/s3.jsonl", [user("no index in this folder")])
    (root / "p1/sessions-index.json").write_text(json.dumps({"entries": [{"sessionId": "s1", "fullPath": "/gone/s1.jsonl", "created": "2025-12-31T00:00:00Z", "summary": "Sum"}, {"sessionId": "s8", "fullPath": "/gone/s8.jsonl"}]}))
    return root


def test_claude_extract(spark, claude_root, tmp_path):
    records = logs.claude_records(logs.parsed(logs.lines(spark, str(claude_root))))
    got = extract.claude_messages(records).orderBy(*logs.ORDER).collect()
    assert [(r.session_id, r.content, r.language, r.project) for r in got] == [
        ("s1", "hola, esto es una prueba de blog", "es", "p1"), ("s1", '["a list in a string"]', "unknown", "p1"), ("s1", "see https://Ex.org:80/a?b and http://y.z\ttab", "unknown", "p1"), ("s2", "the other file with this", "en", "p1"), ("s1", "no index in this folder", "en", "p2"),
    ]
    more = extract.claude_messages(records, include_queue_ops=True, include_slash_commands=True, min_length=1, cwd_pattern="code")
    assert {r.content for r in more.collect()} >= {"/clear all of it", "short"}
    assert extract.claude_messages(records, include_queue_ops=True).where("source_type = 'queue-operation'").count() == 1
    assert extract.claude_messages(records, assume_language="en", language="en").count() == 5
    assert extract.claude_messages(logs.claude_records(logs.parsed(logs.lines(spark, str(claude_root), path_pattern="p2")))).count() == 1
    out = sinks.first_rows(extract.claude_messages(records), logs.ORDER, 3).select("session_id", "content")
    sinks.write_jsonl(out, str(tmp_path / "j"))
    sinks.write_tsv(out, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("part*"))
    assert text.startswith("session_id\tcontent\n") and "http://y.z tab" in text


def test_claude_usage(spark, claude_root):
    lines = logs.lines(spark, str(claude_root))
    records = logs.claude_records(logs.parsed(lines))
    index = logs.resolve_sessions(logs.claude_index(spark, str(claude_root)), lines.select("path").distinct())
    rows = {r.session_id: r for r in usage.claude_sessions(records, index).collect()}
    assert set(rows) == {"s1", "s2"}  # p2 has no index, s8 no file
    s1 = rows["s1"]
    assert (s1.user_messages, s1.queue_messages, s1.assistant_messages, s1.tool_uses, s1.input_tokens, s1.output_tokens, s1.duration_ms, s1.message_count) == (6, 1, 1, 1, 3, 0, 1500, 8)
    assert (s1.created, s1.modified, s1.summary, s1.first_prompt) == (dt.datetime(2025, 12, 31), dt.datetime(2026, 1, 2, 5), "Sum", "hola, esto es una prueba de blog")
    assert rows["s2"].summary == "the other file with this"
    assert {r.session_id for r in usage.claude_sessions(records, index, cwd_pattern="code").collect()} == {"s1"}
    counters = {(r.kind, r.key): r.n for r in usage.merged(usage.claude_counters(records.where("path like '%/s1.jsonl'"))).collect()}
    assert counters[("topic", "blog")] == 1 and counters[("slash", "/clear")] == 1 and counters[("url", "ex.org:80")] == 1 and counters[("url", "y.z")] == 1 and counters[("model", "m")] == 1
    assert [r.session_id for r in usage.in_order(usage.claude_sessions(records, index), "created").collect()] == ["s1", "s2"]
    assert "Sessions: 2" in sinks.markdown("Usage", {"Sessions": 2}, {"Words": [("a", 1)], "None": []}) and sinks.duration(3720) == "1h 2m" and sinks.duration(59) == "0m"


def test_codex(spark, tmp_path):
    event = lambda kind, **p: {"type": kind, "timestamp": "t", "payload": p}
    dump(tmp_path / "sessions/a.jsonl", [
        event("event_msg", type="user_message", message="before any session"), event("session_meta", id="c1", cwd="/w/one", timestamp="2026-01-01T00:00:00Z"), event("event_msg", type="user_message", message="write tests in python"),
        event("event_msg", type="token_count", info={"total_token_usage": {"input_tokens": 9, "output_tokens": 5}}), event("event_msg", type="token_count", info={"total_token_usage": {"input_tokens": 4}}), event("event_msg", type="agent_message", phase="commentary"),
        event("event_msg", type="agent_message", phase="final_answer"), event("response_item", type="function_call", name="shell"), event("response_item", type="message", role="assistant"), event("turn_context", model="m2"),
        event("session_meta", id="c2", cwd="/w/two"), event("event_msg", type="user_message", message="a second session here"),
    ])
    dump(tmp_path / "history.jsonl", [{"session_id": "c1", "ts": 12, "text": "first line here\nmore"}, {"session_id": "c3", "ts": "13", "text": "only in history"}])
    dump(tmp_path / "session_index.jsonl", [{"id": "c1", "thread_name": "old"}, {"id": "c1", "thread_name": "new", "updated_at": "2026-01-05T00:00:00Z"}])
    read = lambda glob: logs.parsed(logs.lines(spark, str(tmp_path), glob=glob), strict=True)
    rollouts, raw_history, threads = logs.codex_rollouts(read("a.jsonl")), read("history.jsonl"), logs.codex_threads(read("session_index.jsonl"))
    got = extract.codex_messages(raw_history, rollouts, threads, logs.session_folders(rollouts)).orderBy("part", *logs.ORDER).collect()
    assert [(r.session_id, r.thread_name, r.source, r.cwd, r.content, r.timestamp) for r in got] == [
        ("c1", "new", "history", "/w/one", "first line here\nmore", "12"), ("c3", "", "history", "", "only in history", "13"), ("", "", "session_event", "", "before any session", "t"),
        ("c1", "new", "session_event", "/w/one", "write tests in python", "t"), ("c2", "", "session_event", "/w/two", "a second session here", "t"),
    ]
    history = logs.codex_history(raw_history)
    rows = {r.session_id: r for r in usage.codex_sessions(threads, history, rollouts).collect()}
    c1 = rows["c1"]
    assert (c1.prompt_count, c1.user_messages, c1.assistant_messages, c1.commentary, c1.final_answers, c1.tool_calls, c1.input_tokens, c1.output_tokens, c1.thread_name) == (1, 1, 1, 1, 1, 1, 9, 5, "new")
    assert rows["c3"].thread_name == "only in history" and set(rows) == {"c1", "c2", "c3"}
    assert {r.session_id for r in usage.codex_sessions(threads, history, rollouts, cwd_pattern="two").collect()} == {"c2"}
    assert {(r.kind, r.key) for r in usage.codex_counters(history, rollouts).collect()} == {("topic", "tests"), ("topic", "python"), ("tool", "shell"), ("model", "m2")}


def test_strict_lines_fail(spark, tmp_path):
    dump(tmp_path / "x.jsonl", ["{broken"])
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        logs.parsed(logs.lines(spark, str(tmp_path)), strict=True).collect()


def test_mining(spark, tmp_path):
    texts = ["Está bien, perfecto", "ni hablar\nqué raro", "Summary: perfecto", "x This session is being continued from a previous conversation perfecto", "perfecto 2", "imperfecto", "PERFECTO 3", "perfecto 4", None, " "]
    dump(tmp_path / "m.jsonl", [{"content": t, "cwd": "/a/code/proj/x" if i % 2 else "/a", "session_id": "s"} for i, t in enumerate(texts)])
    rows = mining.read_mining(spark, str(tmp_path / "m.jsonl"))
    assert rows.count() == 6
    hits = {r.phrase: r for r in mining.rule_hits(rows.withColumn("o", F.monotonically_increasing_id()), ["o"]).collect()}
    assert {p: r.n for p, r in hits.items()} == {"está bien": 1, "perfecto": 4, "ni hablar": 1, "qué raro": 1}
    assert hits["perfecto"].examples == ["Está bien, perfecto", "perfecto 2", "PERFECTO 3"] and hits["ni hablar"].examples == ["ni hablar qué raro"]
    report = mining.report(mining.rule_hits(rows, ["session_id"]), 6)
    assert report.index("## frustration") < report.index("## positive") and "`perfecto` (4 hits, review)" in report
    assert {r.p for r in rows.select(mining.project(F.col("cwd")).alias("p")).collect()} == {"proj", "unknown"}


def test_coverage(spark):
    schema = "text string, type string, language string"
    lex = spark.createDataFrame([("a", "positive", "en"), ("b", "positive", "en"), ("c", "profanity", "es")], schema)
    seen = coverage.exercised(spark.createDataFrame([("Á", "positive", "en"), ("zz", "positive", "en")], schema), spark.createDataFrame([("a", "positive", "en")], schema))
    assert {r.text for r in coverage.phantom(lex, seen).collect()} == {"b", "c"} and [r.text for r in coverage.unconsumed(lex, seen).collect()] == ["zz"] and coverage.known(lex, seen).count() == 1
    rows = {r.language: tuple(r)[1:] for r in coverage.coverage(lex, seen).collect()}
    assert rows == {"en": (2, 2, 1, 50.0), "es": (1, 0, 1, 0.0), None: (3, 2, 2, 33.3)}


def test_wordpiece(spark, tmp_path):
    a = WordPiece({t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "this", "answer", "is", "disappointing", "."])}, 8, lower=True)
    assert a.encode("This answer is disappointing.") == ([2, 4, 5, 6, 7, 8, 3, 0], [1] * 7 + [0])
    b = WordPiece({t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "dis", "##app", "##oint", "##ing"])}, 8)
    assert b.encode("disappointing mystery")[0] == [2, 4, 5, 6, 7, 1, 3, 0]
    assert len(b.encode("x " * 500)[0]) == 8
    (tmp_path / "vocab.txt").write_text("[PAD]\n\n[UNK]\n[CLS]\n[SEP]\nhi\n")
    (tmp_path / "tokenizer_config.json").write_text('{"do_lower_case": true}')
    c = WordPiece.read(str(tmp_path / "vocab.txt"), 4)
    assert c.encode("HI")[0] == [3, 5, 4, 0]
    with pytest.raises(ValueError):
        WordPiece({"[PAD]": 0})
    rows = encode(spark.createDataFrame([("HI",), (None,), ("",)], "text string"), c).collect()
    assert [r.input_ids for r in rows] == [[3, 5, 4, 0], None, [3, 4, 0, 0]]


def test_limiter_against_a_loop(spark):
    import random

    rng, t, rows = random.Random(3), 0.0, []
    for i in range(600):
        t += rng.choice([0, 1, 2, 5, 20, 60, 61])
        rows.append((i, t, "ab"[rng.random() < 0.5], None if rng.random() < 0.9 else "input_too_large"))
    policy = models.LLMScoringPolicy(max_requests_per_minute=4)
    got = {r.i: r.status for r in models.admitted(spark.createDataFrame(rows, "i int, t double, who string, error string"), "t", "i", "who", policy, "error").collect()}
    recent = {"a": [], "b": []}
    for i, at, who, error in rows:
        want = error
        if not error:
            recent[who] = [x for x in recent[who] if x >= at - 60]
            want = "ok" if len(recent[who]) < 4 else "rate_limited"
            if want == "ok":
                recent[who].append(at)
        assert got[i] == want


def test_answers(spark):
    cases = [('{"meanScore": 1.5}', 1.5, None), ('{"meanScore": -2}', -2.0, None), ('{"meanScore": 2.5}', None, "invalid_score"), ('{"meanScore": "1"}', None, "invalid_response"), ('{"meanScore": true}', None, "invalid_response"), ("{}", None, "invalid_response"), ("no", None, "invalid_response"), (None, None, "invalid_response")]
    rows = spark.createDataFrame([(j,) for j, _, _ in cases], "j string").select(models.parsed_score(F.col("j")).alias("p")).collect()
    assert [(r.p.score, r.p.error) for r in rows] == [(s, e) for _, s, e in cases]
    bodies = ['{"output": [{"type": "r"}, {"content": [{"type": "t", "text": "A"}]}]}', '{"content": [{"type": "text", "text": "B"}]}', "{}", None]
    assert [r.t for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(models.response_text(F.col("b")).alias("t")).collect()] == ["A", "B", None, None]


def test_session_scorer(spark):
    talk = spark.createDataFrame([(1, 0, "hi"), (1, 1, None), (2, 0, "x" * 50), (3, 0, "boom")], "conv_id int, turn int, text string")
    metrics = spark.createDataFrame([(i, 0.5, 0.0, 0, None) for i in (1, 2, 3)], "conv_id int, mean_score double, angry_index double, patience int, language string")

    def scorer(instructions, prompt):
        if "boom" in prompt:
            raise RuntimeError("500")
        assert "1. hi\n2. " in prompt and "language: unknown" in prompt
        return '{"content": [{"type": "text", "text": "{\\"meanScore\\": -1}"}]}'

    prompts = models.session_prompts(talk, metrics)
    got = {r.conv_id: (r.mean_score, r.error) for r in models.score_sessions(prompts, scorer, policy=models.LLMScoringPolicy(max_characters=40)).collect()}
    assert got == {1: (-1.0, None), 2: (None, "input_too_large"), 3: (None, "request_failed: 500")}


def test_logits(spark):
    rows = spark.createDataFrame([([9.0, 0.0, 0.0, 0.0],), ([1000.0, 0.0, -1000.0],), ([1.0],), (None,)], "l array<double>").select(models.logit_score(F.col("l")).alias("s")).collect()
    assert [r.s for r in rows] == [0.0, 2.0, None, None]


def test_calendar_and_words(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 2, 3),), (None,)], "ts timestamp")
    assert {(r.kind, r.key): r.n for r in usage.calendar(df, "ts").collect()} == {("day", "2026-01-02"): 1, ("weekday", "Friday"): 1, ("hour", "03"): 1, ("day", "unknown"): 1, ("weekday", "unknown"): 1, ("hour", "unknown"): 1}
    w = spark.createDataFrame([("Está la CASA y la casa_2 ab",)], "t string").select(usage.words(F.col("t"), usage.STOP_A).alias("w")).first().w
    assert w == ["casa", "casa_2"]


def test_paths_are_pruned_before_files_are_opened(spark, tmp_path):
    for name in ("p1/a.jsonl", "p1/subagents/b.jsonl", "p2/c.jsonl"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text('{"x": 1}\n\n{"x": 2}\n')
    got = logs.lines(spark, str(tmp_path), path_pattern="p1")
    assert [r.line for r in got.orderBy("at").collect()] == ['{"x": 1}', '{"x": 2}']
    got.collect()
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().get("numFiles").get().value() == 1


def test_usage_report(spark):
    sessions = spark.createDataFrame([("a", 3, "2026-01-01", "2026-01-02"), ("b", 5, "2025-12-31", None), (None, None, None, None)], "project string, n long, created string, modified string")
    counters = spark.createDataFrame([("s1", "tool", "shell", 2), ("s2", "tool", "shell", 1), ("s1", "tool", "edit", 3), ("s1", "url", "x.y", 1)], "path string, kind string, key string, n long")
    text = usage.report("Usage", sessions, counters, ["n"], k=1)
    assert text == "# Usage\n\n- Sessions: 3\n- Projects: 2\n- From: 2025-12-31\n- To: 2026-01-02\n- n: 8 in all, median 4.0, mean 4.0\n\n## tool\n- `edit`: 3\n\n## url\n- `x.y`: 1\n"
    assert usage.overview(sessions.limit(0), numbers=["n"]).collect()[0].asDict() == {"n_sessions": 0, "n_projects": 0, "first_created": None, "last_modified": None, "total_n": None}


def test_context_stats(spark):
    rows = spark.createDataFrame([(f"s{i % 7}", f"/x/code/p{i % 12}/y") for i in range(36)] + [(None, "/none")], "source string, cwd string")
    got = mining.context_stats(rows, "source", "cwd").collect()
    assert ("total", "messages", 37) in got and len([r for r in got if r.kind == "source"]) == 5 and len([r for r in got if r.kind == "project"]) == 10
    assert ("source", "s0", 6) in got and mining.context_stats(rows.limit(0), "source", "cwd").count() == 0


def test_calendar_is_utc(spark):
    df = spark.sql("SELECT timestamp'2026-01-04 23:30:00Z' AS ts UNION ALL SELECT null")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert {(r.kind, r.key) for r in usage.calendar(df, "ts").collect()} == {("day", "2026-01-04"), ("weekday", "Sunday"), ("hour", "23"), ("day", "unknown"), ("weekday", "unknown"), ("hour", "unknown")}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_model_helpers(tmp_path):
    assert models.model_location(["a", "b"], [str(tmp_path)]) is None
    (tmp_path / "b").write_text("")
    assert models.model_location(["a", "b"], [str(tmp_path / "none"), str(tmp_path)]) == (str(tmp_path / "b"), None)
    (tmp_path / "tokenizer").mkdir()
    assert models.model_location(["a", "b"], [str(tmp_path)]) == (str(tmp_path / "b"), str(tmp_path / "tokenizer"))
    assert models.answer_schema()["required"] == ["meanScore"] and models.answer_schema()["additionalProperties"] is False


def test_fixtures_are_read(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "text": "x"},\n {"id": "2", "text": null}]')
    (tmp_path / "b.json").write_text('{"id": "3",\n "text": "é"}')
    assert {tuple(r) for r in fixtures.read(spark, str(tmp_path), "id string, text string").collect()} == {("1", "x"), ("2", None), ("3", "é")}
