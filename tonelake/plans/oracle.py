"""DuckDB SQL for the registered queries, written relationally and independently of the Column expressions; constants come from the same lists."""

from __future__ import annotations

from ..lexicon import TYPES, builtin
from ..operators import guard, language, mining, usage
from . import queries as q


def _s(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_s(x) for x in xs) + "]"


_PIECE = r"(?:[\p{L}\p{M}\p{N}]|[^\p{L}\p{M}\p{N}]\p{M})+"


def _fold(x: str) -> str:
    return f"replace(lower(strip_accents({x})), 'ß', 'ss')"


def _opened(openings: list[str]) -> str:
    return f"SELECT conv_id, turn, role, {_list(openings)}[(conv_id * 31 + turn * 7) % {len(openings)} + 1] || ' ' || coalesce(text, '') AS text FROM conversations"


def _seeded() -> str:
    seeds = q.seeds()
    at = f"[(conv_id * 31 + turn * 7) % {len(seeds)} + 1]"
    return f"SELECT conv_id, turn, {_list(t for t, _ in seeds)}{at} || ' ' || coalesce(text, '') AS text, {_list(x for _, x in seeds)}{at} AS lang FROM conversations"


def _matches(source: str, keys: str) -> str:
    """CTEs src, tok and m: one row for each accepted match. s and e are token places from 0."""
    values = ", ".join(f"({r.rank}, {len(r.tokens)}, {_list(r.tokens)}, {_s(r.entry.text)}, {_s(r.entry.type)}, {_s(r.entry.lang)}, CAST({r.entry.score!r} AS DOUBLE))" for r in builtin().ranked)
    return f"""src AS ({source}),
    raws AS (SELECT *, regexp_extract_all(text, '{_PIECE}') AS raw FROM src),
    tok AS (SELECT *, list_transform(raw, lambda x: {_fold("x")}) AS norm FROM raws),
    lex(rank, n, toks, entry, kind, lex_lang, weight) AS (VALUES {values}),
    words AS (SELECT {keys}, unnest(norm) AS w, unnest(range(len(norm))) AS i FROM tok),
    first AS (SELECT {keys}, i, lex.* FROM words JOIN lex ON w = toks[1]),
    cand AS (SELECT {keys}, {{'rank': rank, 's': i, 'e': i + n - 1, 'entry': entry, 'kind': kind, 'lang': lex_lang, 'weight': weight}} AS c
             FROM first JOIN tok USING ({keys}) WHERE norm[i + 1 : i + n] = toks AND (tok.lang IS NULL OR tok.lang = lex_lang)),
    taken AS (SELECT {keys}, list_reduce(list([c] ORDER BY c.rank, c.s), lambda a, b: CASE WHEN len(list_filter(a, lambda x: x.s <= b[1].e AND b[1].s <= x.e)) > 0 THEN a ELSE list_concat(a, b) END) AS ms FROM cand GROUP BY {keys}),
    m AS (SELECT {keys}, unnest(ms, recursive := true) FROM taken)"""


def _ruled(source: str, keys: str) -> str:
    lex = builtin()
    neg, inten, dim, conj = (lex.role(r) for r in ("negation", "intensifier", "diminisher", "conjunction"))
    conj_values = ", ".join(f"({len(p)}, {_list(p)}, {_s(' '.join(p))})" for p in sorted(conj.phrases))
    factors = " ".join(f"WHEN {_s(t)} THEN {f!r}" for t, f in sorted(inten.factors.items()))
    return f"""{_matches(source, keys)},
    conj(n, toks, phrase) AS (VALUES {conj_values}),
    said AS (SELECT {keys}, i, conj.* FROM words JOIN conj ON w = toks[1]),
    turns AS (SELECT {keys}, first(i ORDER BY n, phrase, i DESC) AS turn_at FROM said JOIN tok USING ({keys}) WHERE norm[i + 1 : i + n] = toks GROUP BY {keys}),
    near AS (SELECT m.*, raw, norm, text, turn_at,
             CASE WHEN s > 0 THEN norm[greatest(1, s - 1) : s] ELSE [] END AS one2, CASE WHEN s > 1 THEN [norm[s - 1] || ' ' || norm[s]] ELSE [] END AS two2,
             CASE WHEN s > 0 THEN norm[greatest(1, s - 2) : s] ELSE [] END AS one3, CASE WHEN s > 2 THEN [norm[s - 2] || ' ' || norm[s - 1], norm[s - 2] || ' ' || norm[s - 1] || ' ' || norm[s]] ELSE [] END AS more3
             FROM m JOIN tok USING ({keys}) LEFT JOIN turns USING ({keys})),
    flags AS (SELECT *, list_has_any(list_concat(one2, two2), {_list(neg.texts)}) AS negated, list_has_any(list_concat(one3, two2, more3), {_list(dim.texts)}) AS dimmed,
              coalesce(list_filter(two2, lambda g: list_contains({_list(inten.texts)}, g))[1], list_max(list_filter(one2, lambda g: list_contains({_list(inten.texts)}, g)))) AS strong,
              len(list_filter(raw[s + 1 : e + 1], lambda x: length(x) >= 2 AND x = upper(x) AND x <> lower(x))) = e - s + 1 AS caps FROM near),
    ruled AS (SELECT *, weight * CASE WHEN negated THEN -0.75 ELSE 1.0 END::DOUBLE * CASE WHEN strong IS NULL THEN 1.0 ELSE CASE strong {factors} ELSE 1.3 END END::DOUBLE * CASE WHEN dimmed THEN 0.7 ELSE 1.0 END::DOUBLE
              * CASE WHEN s > turn_at THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN caps THEN 1.2 ELSE 1.0 END::DOUBLE AS adjusted FROM flags)"""


def _scored(source: str, keys: str) -> str:
    """CTE final: one row for each message, with visible matches as lists in order."""
    return f"""{_ruled(source, keys)},
    sums AS (SELECT {keys}, sum(adjusted ORDER BY s) AS total, sum(CASE WHEN caps THEN 0.2 ELSE 0.0 END::DOUBLE) AS raised FROM ruled GROUP BY {keys}),
    marks AS (SELECT {keys}, text, lang, least(0.4, (length(text) - length(replace(text, '!', ''))) * 0.1)::DOUBLE AS loud, contains(text, '?') AS asks FROM src),
    final AS (SELECT {keys}, marks.lang, marks.text,
              CASE WHEN total IS NULL THEN 0.0 ELSE greatest(-2.0, least(2.0, total * (1 + loud) * CASE WHEN asks THEN 0.9 ELSE 1.0 END::DOUBLE)) END::DOUBLE AS score,
              CASE WHEN total IS NULL THEN 0.0 ELSE least(1.0, raised + loud + CASE WHEN asks THEN 0.05 ELSE 0.0 END::DOUBLE) END::DOUBLE AS intensity
              FROM marks LEFT JOIN sums USING ({keys})),
    visible AS (SELECT {keys}, s, entry, kind, m_lang FROM (SELECT *, lang AS m_lang FROM ruled) WHERE NOT negated)"""


_K = "conv_id, turn"


def _votes(words: list[str], padded: str) -> str:
    return " + ".join(f"CAST(contains({padded}, {_s(f' {w} ')}) AS INT)" for w in words)


def _log_language(text: str) -> str:
    p = f"(' ' || lower({text}) || ' ')"
    es = f"({_votes(language.SPANISH, p)} + CASE WHEN regexp_matches({p}, '[áéíóúñ¿¡]') THEN 2 ELSE 0 END)"
    en = f"({_votes(language.ENGLISH, p)})"
    return f"CASE WHEN {es} > {en} THEN 'es' WHEN {en} > {es} THEN 'en' ELSE 'unknown' END"


def _detected(source: str) -> str:
    """(id, text) -> detected."""
    votes = ", ".join(f"({_s(lang)}, {_list(sorted(set(w.split())))})" for lang, w in language.VOTES.items())
    return f"""WITH src AS ({source}), tok AS (SELECT id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '{_PIECE}'), lambda x: {_fold("x")}), lambda x: x <> '') AS norm FROM src),
    votes(lang, words) AS (VALUES {votes}), n AS (SELECT id, lang, len(list_filter(norm, lambda t: list_contains(words, t))) AS n FROM tok, votes),
    best AS (SELECT id, first(lang ORDER BY n DESC, lang) AS lang, max(n) AS n FROM n GROUP BY id)"""


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _topics(text: str, patterns: dict[str, str] = usage.TOPICS_A) -> str:
    # RE2's word borders are ASCII; so are these words' ends
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower({text}), {_s(p)}) THEN {_s(n)} END" for n, p in sorted(patterns.items())) + "], lambda x: x IS NOT NULL)"


_HOSTS = """list_transform(regexp_extract_all({0}, 'https?://[^\\s)>"]+'), lambda u: lower(split_part(regexp_replace(u, '^https?://', ''), '/', 1)))"""


def _sessions() -> str:
    return f"""WITH t AS ({_opened(q.TALK)}), f AS (SELECT conv_id, first(text ORDER BY turn) AS p FROM t WHERE role = 'user' GROUP BY conv_id),
    g AS (SELECT conv_id, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role NOT IN ('user', 'assistant')) AS queue_messages, count(*) FILTER (role = 'assistant') AS assistant_messages, count(*) AS message_count,
          CAST(coalesce(sum(turn % 3) FILTER (role = 'assistant'), 0) AS BIGINT) AS tool_uses, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(turn + 1) FILTER (role = 'assistant'), 0) AS BIGINT) AS output_tokens,
          min(turn) AS lo, max(turn) AS hi FROM t GROUP BY conv_id)"""


def oracle_sql() -> dict[str, str]:
    seeded = _seeded()
    docs = "SELECT doc_id, text, lang FROM documents"
    match_rows = f"WITH {_matches(seeded, _K)} SELECT {_K}, CAST(s AS BIGINT) AS start_at, CAST(e AS BIGINT) AS end_at, entry AS text, kind AS type, lang, weight AS score FROM m"
    final = f"WITH {_scored(seeded, _K)}"
    seen = f"""{final}, seen AS (SELECT DISTINCT entry AS text, kind AS type, m_lang AS language FROM visible UNION SELECT DISTINCT {_fold("source")}, 'positive', lang FROM documents),
    own AS (SELECT DISTINCT entry AS text, kind AS type, lex_lang AS language FROM lex)"""
    lists = ", ".join(f"coalesce(string_agg(entry, ',' ORDER BY s) FILTER (kind = '{t}'), '') AS expected_{t}" for t in TYPES)
    rules = ", ".join(f"({i}, {_s(r.phrase)}, {_s(r.bucket)}, {_s(r.kind)})" for i, r in enumerate(mining.RULES))
    guard_phrases = " OR ".join([*(f"contains(lower(text), {_s(p)})" for p in guard.PHRASES), *(f"contains(text, {_s(p)})" for p in guard.MARKS)])
    metrics = f"""{final}, n AS (SELECT {_K}, count(*) FILTER (kind <> 'positive') AS angry FROM visible GROUP BY {_K}), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM final LEFT JOIN n USING ({_K})),
            l AS (SELECT conv_id, lang, count(*) AS n FROM final WHERE lang IS NOT NULL GROUP BY ALL), best AS (SELECT conv_id, first(lang ORDER BY n DESC, lang) AS language FROM l GROUP BY conv_id),
            e AS (SELECT conv_id, count(DISTINCT (entry, kind, m_lang)) AS n_expressions FROM visible GROUP BY conv_id)
            SELECT conv_id, count(*) AS n_messages, round(avg(score), 8) AS mean_score, round(stddev_pop(score), 8) AS stddev, round(coalesce(sum(angry), 0) / count(*), 8) AS angry_index, coalesce(min(pos) FILTER (angry > 0), 0) AS patience,
                   any_value(language) AS language, coalesce(any_value(n_expressions), 0) AS n_expressions FROM placed LEFT JOIN best USING (conv_id) LEFT JOIN e USING (conv_id) GROUP BY conv_id"""
    least = f"CASE WHEN n > 0 AND len(norm) >= {language.LEAST_TOKENS} THEN lang END AS detected"
    sampled = f"""{_detected(f"SELECT conv_id AS id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM ({seeded})) WHERE r <= 5 GROUP BY conv_id")} SELECT id AS conv_id, {least} FROM best JOIN tok USING (id)"""
    return {
        "tokens_fold": f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '{_PIECE}') AS raw FROM documents)
            SELECT doc_id, len(raw) AS n_tokens, len(list_filter(raw, lambda x: length(x) >= 2 AND x = upper(x) AND x <> lower(x))) AS n_caps, coalesce(list_aggregate(list_transform(raw, lambda x: {_fold("x")}), 'string_agg', ' '), '') AS folded FROM t""",
        "keyword_matches": match_rows,
        "keyword_matches_join": match_rows,
        "rule_effects": f"WITH {_ruled(seeded, _K)} SELECT {_K}, CAST(s AS BIGINT) AS start_at, negated, caps, round(adjusted, 10) AS adjusted FROM ruled",
        "message_score": f"{final} SELECT {_K}, round(score, 10) AS score, round(intensity, 10) AS intensity FROM final",
        "document_score": f"WITH {_scored(docs, 'doc_id')} SELECT doc_id, round(score, 10) AS score, round(intensity, 10) AS intensity FROM final",
        "visible_expressions": f"{final} SELECT {_K}, entry AS text, kind AS type, m_lang AS language FROM visible",
        "session_metrics": metrics,
        "session_analysis": f"""SELECT m.* REPLACE (coalesce(d.detected, m.language) AS language) FROM ({metrics}) m LEFT JOIN ({sampled}) d USING (conv_id)""",
        "session_overrides": f"""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), every AS (SELECT conv_id, n FROM n UNION ALL SELECT conv_id + 1000000, n FROM n)
            SELECT conv_id, coalesce(n_messages, 0) AS n_messages, CASE WHEN n_messages IS NULL THEN 0.0 WHEN n > 2 THEN greatest(-2.0, least(2.0, CAST(n - 4 AS DOUBLE))) ELSE mean_score END::DOUBLE AS mean_score, coalesce(stddev, 0.0)::DOUBLE AS stddev, coalesce(angry_index, 0.0)::DOUBLE AS angry_index,
                   coalesce(patience, 0) AS patience, language, coalesce(n_expressions, 0) AS n_expressions FROM every LEFT JOIN ({metrics}) m USING (conv_id)""",
        "top_expressions": f"{final} SELECT entry AS text, kind AS type, m_lang AS language, count(*) AS n FROM visible GROUP BY ALL ORDER BY n DESC, text, type, language LIMIT {q.TOP}",
        "language_heuristic": f"""SELECT 'documents' AS origin, doc_id AS id, CAST(0 AS BIGINT) AS turn, {_log_language("text")} AS language FROM documents
            UNION ALL SELECT 'conversations', conv_id, turn, {_log_language("text")} FROM ({_opened(q.TALK)})""",
        "language_detect": f"{_detected('SELECT doc_id AS id, text FROM documents')} SELECT id AS doc_id, CASE WHEN n > 0 AND len(norm) >= {language.LEAST_TOKENS} THEN lang END AS detected FROM best JOIN tok USING (id)",
        "session_language": f"""{_detected("SELECT conv_id AS id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 5 GROUP BY conv_id")}
            SELECT id AS conv_id, CASE WHEN n > 0 AND len(norm) >= {language.LEAST_TOKENS} THEN lang END AS detected FROM best JOIN tok USING (id)""",
        "dominant_language": "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE r = 1",
        "guard_flags": f"""WITH t AS (SELECT conv_id, turn, text, list_transform(regexp_extract_all(text, '{_PIECE}'), lambda x: {_fold("x")}) AS norm FROM ({_opened(q.COMMANDS)}))
            SELECT conv_id, turn, len(norm) = 0 OR (len(norm) = 1 AND list_contains({_list(guard.ANSWERS)}, norm[1])) OR list_contains({_list(guard.COMMANDS)}, norm[1]) OR list_has_any(norm, {_list([*guard.TERMS, 'git', 'make'])})
                   OR {guard_phrases} OR len(list_filter(norm, lambda t: list_contains({_list(guard.TECHNICAL)}, t))) >= 2 AS technical FROM t""",
        "coverage_phantom": f"{seen} SELECT * FROM own EXCEPT SELECT * FROM seen",
        "coverage_unconsumed": f"{seen} SELECT * FROM seen EXCEPT SELECT * FROM own",
        "coverage_summary": f"""{seen}, b AS (SELECT coalesce(own.language, seen.language) AS language, own.text IS NOT NULL AS o, seen.text IS NOT NULL AS s FROM own FULL JOIN seen USING (text, type, language))
            SELECT language, count(*) FILTER (o) AS n_lexicon, count(*) FILTER (s) AS n_seen, count(*) FILTER (o AND NOT s) AS n_phantom, round(count(*) FILTER (o AND s) * 100.0 / nullif(count(*) FILTER (o), 0), 1) AS coverage FROM b GROUP BY ROLLUP (language)""",
        "rule_mining": rf"""WITH r(i, phrase, bucket, kind) AS (VALUES {rules}), t AS (SELECT conv_id, turn, replace({_strip("text")}, chr(10), ' ') AS c FROM ({_opened(q.TALK)})),
            h AS (SELECT r.*, c, row_number() OVER (PARTITION BY i ORDER BY conv_id, turn) AS k FROM t JOIN r ON regexp_matches(c, '(?i)\b' || phrase || '\b'))
            SELECT phrase, bucket, kind, count(*) AS n, string_agg(c, ' | ' ORDER BY k) FILTER (k <= 3) AS examples FROM h GROUP BY ALL""",
        "topic_hist": f"SELECT topic, count(*) AS n FROM (SELECT unnest({_topics('text')}) AS topic FROM ({_opened(q.TALK)})) GROUP BY topic",
        "slash_hist": rf"SELECT regexp_extract({_strip('text')}, '^/\S*') AS command, count(*) AS n FROM ({_opened(q.TALK)}) WHERE {_strip('text')} LIKE '/%' GROUP BY ALL",
        "url_hosts": f"SELECT host, count(*) AS n FROM (SELECT unnest({_HOSTS.format("url || ' ' || html")}) AS host FROM pages) GROUP BY host",
        "word_hist": rf"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]{{3,}}')) AS word FROM documents) WHERE NOT list_contains({_list(usage.STOP_A)}, word) GROUP BY word",
        "top_words": rf"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]{{3,}}')) AS word FROM documents) WHERE NOT list_contains({_list(usage.STOP_A)}, word) GROUP BY word ORDER BY n DESC, word LIMIT {q.TOP}",
        "calendar_hist": """SELECT kind, key, count(*) AS n FROM (SELECT unnest([{'kind': 'day', 'key': coalesce(strftime(ts, '%Y-%m-%d'), 'unknown')}, {'kind': 'weekday', 'key': coalesce(strftime(ts, '%A'), 'unknown')}, {'kind': 'hour', 'key': coalesce(strftime(ts, '%H'), 'unknown')}], recursive := true) FROM events) GROUP BY ALL""",
        "claude_sessions": f"""{_sessions()} SELECT 's' || conv_id AS session_id, 'p' || (conv_id % 5) AS project, user_messages, queue_messages, assistant_messages, message_count, tool_uses, input_tokens, output_tokens, CAST(0 AS BIGINT) AS cache_read_tokens,
            1700000000 + conv_id * 3600 + lo * 60 AS created_s, 1700000000 + conv_id * 3600 + hi * 60 AS modified_s, coalesce(p, '') AS first_prompt, substr(coalesce(p, ''), 1, 120) AS summary FROM g LEFT JOIN f USING (conv_id)""",
        "claude_counters": rf"""WITH t AS ({_opened(q.TALK)}), said AS (SELECT * FROM t WHERE role <> 'assistant'), c AS (
            SELECT 'cwd' AS kind, '/home/me/code/p' || (conv_id % 7) AS key FROM t UNION ALL SELECT 'permission_mode', 'default' FROM t WHERE role = 'user' UNION ALL SELECT 'model', 'm1' FROM t WHERE role = 'assistant'
            UNION ALL SELECT 'topic', unnest({_topics("text")}) FROM said UNION ALL SELECT 'slash', regexp_extract({_strip("text")}, '^/\S*') FROM said WHERE {_strip("text")} LIKE '/%' UNION ALL SELECT 'url', unnest({_HOSTS.format("text")}) FROM said)
            SELECT kind, key, count(*) AS n FROM c WHERE key <> '' GROUP BY ALL""",
        "claude_messages": rf"""WITH t AS (SELECT *, {_strip("text")} AS c FROM ({_opened(q.TALK)}) WHERE role <> 'assistant')
            SELECT 's' || conv_id AS session_id, turn, 'p' || (conv_id % 5) AS project, CASE WHEN role = 'user' THEN 'user' ELSE 'queue-operation' END AS source_type, '/home/me/code/p' || (conv_id % 7) AS cwd, {_log_language("text")} AS language, CAST(length(c) AS INT) AS n_chars
            FROM t WHERE length(c) >= 8 AND c NOT LIKE '/%' AND NOT regexp_matches(c, '^<(local-command-(caveat|stdout|stderr)|task-notification)>')""",
        "session_shape": f"""{_sessions()} SELECT count(*) AS n_sessions, CAST(sum(message_count) AS DOUBLE) AS total_message_count, CAST(median(message_count) AS DOUBLE) AS median_message_count, round(avg(message_count), 8) AS mean_message_count,
            CAST(sum(user_messages) AS DOUBLE) AS total_user_messages, CAST(median(user_messages) AS DOUBLE) AS median_user_messages, round(avg(user_messages), 8) AS mean_user_messages FROM g""",
        "biggest_sessions": f"{_sessions()} SELECT 's' || conv_id AS session_id, user_messages, message_count FROM g ORDER BY user_messages DESC, message_count DESC, session_id LIMIT {q.TOP}",
        "codex_sessions": """SELECT 'c' || conv_id AS session_id, '/w/' || (conv_id % 4) AS cwd, count(*) FILTER (role = 'user') AS prompt_count, count(*) FILTER (role = 'user') AS user_messages, count(*) FILTER (role = 'assistant') AS assistant_messages,
            count(*) FILTER (role <> 'user') AS tool_calls, coalesce(max((turn + 1) * 100) FILTER (role IN ('user', 'assistant')), 0) AS input_tokens, coalesce(max(turn + 1) FILTER (role IN ('user', 'assistant')), 0) AS output_tokens FROM conversations GROUP BY conv_id""",
        "codex_counters": f"""WITH t AS ({_opened(q.TALK)}), c AS (SELECT 'tool' AS kind, 'shell' AS key FROM t WHERE role <> 'user' UNION ALL SELECT 'topic', unnest({_topics("text", usage.TOPICS_B)}) FROM t WHERE role = 'user' UNION ALL SELECT 'url', unnest({_HOSTS.format("text")}) FROM t WHERE role = 'user')
            SELECT kind, key, count(*) AS n FROM c WHERE key <> '' GROUP BY ALL""",
        "usage_overview": f"""{_sessions()} SELECT count(*) AS n_sessions, count(DISTINCT conv_id % 5) AS n_projects, min(1700000000 + conv_id * 3600 + lo * 60) AS first_s, max(1700000000 + conv_id * 3600 + hi * 60) AS last_s,
            CAST(sum(message_count) AS BIGINT) AS total_message_count, CAST(sum(tool_uses) AS BIGINT) AS total_tool_uses FROM g""",
        "context_stats": rf"""WITH t AS (SELECT *, {_strip("text")} AS c FROM ({_opened(q.TALK)}) WHERE role <> 'assistant'), k AS (SELECT * FROM t WHERE length(c) >= 8 AND c NOT LIKE '/%' AND NOT regexp_matches(c, '^<(local-command-(caveat|stdout|stderr)|task-notification)>')),
            n AS (SELECT 'total' AS kind, 'messages' AS key, count(*) AS n FROM k HAVING count(*) > 0 UNION ALL SELECT 'source', CASE WHEN role = 'user' THEN 'user' ELSE 'queue-operation' END AS key, count(*) FROM k GROUP BY 2 UNION ALL SELECT 'project', 'p' || (conv_id % 7) AS key, count(*) FROM k GROUP BY 2)
            SELECT kind, key, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS r FROM n) WHERE r <= CASE kind WHEN 'source' THEN 5 WHEN 'project' THEN 10 ELSE 1 END""",
        "tolerant_records": """SELECT 'f' || conv_id AS session_id, turn, 'p' || (conv_id % 5) AS project, CASE WHEN (conv_id + turn) % 9 = 7 THEN 'summary' ELSE 'user' END AS type, (conv_id + turn) % 9 = 6 AS is_meta,
            CASE WHEN (conv_id + turn) % 9 IN (0, 6) THEN 'said at turn ' || turn END AS content FROM conversations WHERE (conv_id + turn) % 9 IN (0, 5, 6, 7)""",
        "kept_messages": "SELECT 'f' || conv_id AS session_id, turn, 'said at turn ' || turn AS content FROM conversations WHERE (conv_id + turn) % 9 = 0",
        "session_index": """SELECT 'file:/l/p' || (conv_id % 6) || '/s' || conv_id || '.jsonl' AS path, 's' || conv_id AS session_id, CASE WHEN conv_id % 5 <> 3 THEN 'sum s' || conv_id END AS summary FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 6 <> 5 AND conv_id % 5 <> 4""",
        "codex_threads": """SELECT 'c' || conv_id AS session_id, CASE WHEN max(turn) % 4 = 3 THEN '' ELSE 'thread ' || max(turn) END AS thread_name FROM conversations WHERE conv_id % 3 <> 0 AND turn % 5 <> 2 GROUP BY conv_id""",
        "codex_folders": "SELECT DISTINCT 'c' || conv_id AS session_id, '/w/' || (conv_id % 4) AS cwd FROM conversations",
        "codex_messages": rf"""WITH t AS (SELECT *, {_strip("text")} AS c, {_log_language("text")} AS language FROM ({_opened(q.TALK)}) WHERE role = 'user'),
            h AS (SELECT conv_id, CASE WHEN max(turn) % 4 = 3 THEN '' ELSE 'thread ' || max(turn) END AS name FROM conversations WHERE conv_id % 3 <> 0 AND turn % 5 <> 2 GROUP BY conv_id),
            m AS (SELECT 0 AS part, 'history' AS source, *, turn % 4 <> 0 AS known FROM t WHERE turn % 6 <> 2 UNION ALL SELECT 1, 'session_event', *, true FROM t)
            SELECT CAST(part AS INT) AS part, CASE WHEN known THEN 'c' || conv_id ELSE 'elsewhere' END AS session_id, CASE WHEN known THEN coalesce(name, '') ELSE '' END AS thread_name, source, CASE WHEN known THEN '/w/' || (conv_id % 4) ELSE '' END AS cwd, language,
                   count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS n_chars FROM m LEFT JOIN h USING (conv_id) WHERE length(c) >= 12 GROUP BY ALL""",
        "rate_limiter": """WITH RECURSIVE e AS (SELECT event_id, event_type, t, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) AS r FROM (SELECT *, CAST(epoch_us(ts) // 600000000 AS BIGINT) * 1000000 AS t FROM events)),
            a(event_type, r, taken) AS (SELECT event_type, r, [t] FROM e WHERE r = 1
                UNION ALL SELECT a.event_type, n.r, list_append(a.taken, n.t)[-10:] FROM a, LATERAL (SELECT min(e.r) AS r, arg_min(e.t, e.r) AS t FROM e WHERE e.event_type = a.event_type AND e.r > a.r AND (len(a.taken) < 10 OR e.t > a.taken[1] + 60000000)) n WHERE n.r IS NOT NULL)
            SELECT event_id, event_type, CASE WHEN a.r IS NOT NULL THEN 'ok' ELSE 'rate_limited' END AS status FROM e LEFT JOIN a USING (event_type, r)""",
        "suggested_fixtures": f"""{final}, l AS (SELECT {_K}, {lists} FROM final LEFT JOIN visible USING ({_K}) GROUP BY {_K})
            SELECT coalesce(lang, 'en') || '-' || CASE WHEN expected_profanity <> '' AND (expected_frustration <> '' OR expected_positive <> '') THEN 'mixed' WHEN expected_profanity <> '' THEN 'profanity' WHEN expected_frustration <> '' AND expected_positive <> '' THEN 'mixed'
                   WHEN expected_frustration <> '' THEN 'frustration' WHEN expected_positive <> '' THEN 'positive' ELSE 'neutral' END || '-001' AS id, text, coalesce(lang, 'en') AS language, expected_profanity, expected_frustration, expected_positive,
                   round(round(score - 0.15, 10) * 100) / 100 AS expected_score_min, round(round(score + 0.15, 10) * 100) / 100 AS expected_score_max FROM final JOIN l USING ({_K})""",
        "request_sizes": """SELECT conv_id, count(*) AS n_messages, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_characters, CASE WHEN count(*) > 6 THEN 'too_many_messages' WHEN sum(length(coalesce(text, ''))) > 4000 THEN 'input_too_large' END AS error FROM conversations GROUP BY conv_id""",
        "response_scores": """SELECT event_id, CASE WHEN event_id % 5 > 2 AND event_id % 7 < 2 THEN CAST(event_id % 7 AS DOUBLE) + 0.5 END AS score, CASE WHEN event_id % 5 <= 2 THEN 'invalid_response' WHEN event_id % 7 >= 2 THEN 'invalid_score' END AS error FROM events""",
        "softmax_score": """WITH t AS (SELECT vec_id, list_transform(embedding[-3:], lambda v: v::DOUBLE) AS l FROM embeddings), e AS (SELECT vec_id, list_transform(l, lambda v: exp(v - list_max(l))) AS p FROM t)
            SELECT vec_id, round(greatest(-2.0, least(2.0, (p[1] - p[3]) / list_sum(p) * 2)), 6) AS score FROM e""",
        "lexicon_lint": "SELECT lang, count(*) AS n, CAST(0 AS BIGINT) AS n_unfolded FROM (VALUES " + ", ".join(f"({_s(e.lang)})" for e in builtin().entries) + ") t(lang) GROUP BY lang",
    }
