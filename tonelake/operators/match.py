"""Lexicon matching: the longest expression first, no token used twice.

Two forms give the same rows. ``found`` looks the first token of every candidate up in the row itself: the lexicon is one literal of the plan, and nothing is
shuffled. ``found_by_join`` explodes tokens and joins them with the lexicon as a table; it is for lexicons of more than ``MOST_LITERAL`` entries.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lexicon import Lexicon

#: Entries that a plan holds as a literal.
MOST_LITERAL = 20_000
MATCH = "struct<rank:int,start:int,end:int,text:string,type:string,lang:string,score:double>"
_CANDIDATE = "rank int, n int, tokens array<string>, text string, type string, lang string, score double, any_lang boolean"


def _rows(lexicon: Lexicon) -> list[dict]:
    return [{"rank": r.rank, "n": len(r.tokens), "tokens": list(r.tokens), "text": r.entry.text, "type": r.entry.type, "lang": r.entry.lang, "score": r.entry.score, "any_lang": r.entry.any_lang} for r in lexicon.ranked]


def places(n: Column) -> Column:
    """0 .. n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _eligible(c: Column, lang: Column) -> Column:
    """All languages compete for a message without one."""
    return lang.isNull() | (c["lang"] == lang) | c["any_lang"]


def _match(c: Column, start: Column) -> Column:
    return F.struct(c["rank"].alias("rank"), start.alias("start"), (start + c["n"] - 1).alias("end"), c["text"].alias("text"), c["type"].alias("type"), c["lang"].alias("lang"), c["score"].alias("score"))


def without_overlap(candidates: Column) -> Column:
    """Of candidates, in order of rank and start, those that share no token with one taken before; then in order of start."""
    none = F.array().cast(f"array<{MATCH}>")
    taken = F.aggregate(
        F.array_sort(candidates), none, lambda acc, c: F.when(F.exists(acc, lambda a: (a["start"] <= c["end"]) & (c["start"] <= a["end"])), acc).otherwise(F.concat(acc, F.array(c)))
    )
    by_start = F.array_sort(F.transform(taken, lambda m: F.struct(m["start"].alias("at"), m.alias("m"))))
    return F.when(F.size(candidates) > 0, F.transform(by_start, lambda x: x["m"])).otherwise(none)


def found(norm: Column, lang: Column, lexicon: Lexicon) -> Column:
    """Matches of a token list, by start. lang: the message's language, or null."""
    rows = _rows(lexicon)
    if len(rows) > MOST_LITERAL:
        raise ValueError(f"a lexicon of more than {MOST_LITERAL} entries is for found_by_join")
    if not rows:
        return F.array().cast(f"array<{MATCH}>")
    by_first: dict[str, list[dict]] = {}
    for r in rows:
        by_first.setdefault(r["tokens"][0], []).append(r)
    table = F.from_json(F.lit(json.dumps(by_first, ensure_ascii=False)), f"map<string, array<struct<{_CANDIDATE.replace(' ', ':').replace(',:', ',')}>>>")  # folded to a literal
    # a hashed set test for every token; the map is asked for the few that begin an entry
    hits = F.filter(places(F.size(norm)), lambda i: F.get(norm, i).isin(sorted(by_first)))
    each = F.transform(hits, lambda i: F.transform(F.filter(F.element_at(table, F.get(norm, i)), lambda c: _eligible(c, lang) & (F.slice(norm, i + 1, c["n"]) == c["tokens"])), lambda c: _match(c, i)))
    return F.flatten(each)


def found_by_join(messages: DataFrame, lexicon: DataFrame, key: str = "key", norm: str = "norm", lang: str = "lang") -> DataFrame:
    """(key, candidates) for the messages that have any. lexicon: as ``lexicon_table`` gives it; Spark broadcasts it if it is small, and shuffles both sides if not."""
    # a token row holds as many tokens as the longest entry, not the whole message: else what is shuffled grows with the square of its length
    ahead = F.slice(F.col(norm), F.col("start") + 1, F.coalesce(lexicon.select(F.max("n")).scalar(), F.lit(0)))
    tokens = messages.select(key, lang, norm, F.posexplode(norm).alias("start", "first")).select(key, lang, "start", "first", ahead.alias("__ahead"))
    lex = lexicon.withColumnRenamed("lang", "lex_lang").withColumn("first", F.element_at("tokens", 1))
    ok = (F.col(lang).isNull() | (F.col("lex_lang") == F.col(lang)) | F.col("any_lang")) & (F.slice("__ahead", 1, F.col("n")) == F.col("tokens"))
    match = F.struct("rank", "start", (F.col("start") + F.col("n") - 1).alias("end"), "text", "type", F.col("lex_lang").alias("lang"), "score")
    return tokens.join(lex, "first").where(ok).groupBy(key).agg(F.collect_list(match).alias("candidates"))


def lexicon_table(spark, lexicon: Lexicon) -> DataFrame:
    """(rank, n, tokens, text, type, lang, score, any_lang): one row for each entry, in order of rank. It comes to Spark as an Arrow table, whose size the planner knows: a small one is broadcast."""
    kinds = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in _CANDIDATE.split(", "))])
    return spark.createDataFrame(pa.Table.from_pylist(_rows(lexicon), schema=schema), _CANDIDATE)


def expressions(matches: Column, kind: str) -> Column:
    """The matches of one type as struct(text, type, language)."""
    return F.transform(F.filter(matches, lambda m: m["type"] == kind), lambda m: F.struct(m["text"].alias("text"), m["type"].alias("type"), m["lang"].alias("language")))
