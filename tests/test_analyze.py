import random
import time

import pytest
from pyspark.sql import functions as F

from tonelake import lexicon as L
from tonelake.functions.text import fold, folded_tokens, is_caps, pieces, raw_tokens
from tonelake.operators import analyze, guard, language, match, rules
from tonelake.operators.analyze import SentimentConfig, analyze_messages, with_matches, with_tokens

SCORES = [
    ("qué coño es esto, no funciona una mierda", "es", -2.0), ("this is not good at all", "en", -0.75), ("this is not bad", None, 0.75), ("this has never been better", "en", 1.2), ("very bad", None, -1.3), ("un poco malo", None, -0.7),
    ("good but bad", None, -0.5), ("o resultado não está horrivel", "pt", 0.525), ("这不是坏", "zh", 0.525), ("这很坏", "zh", -0.91), ("这非常坏", "zh", -1.12), ("这很棒", "zh", 1.3), ("这非常棒", "zh", 1.6), ("esto es de puta madre", "es", 1.5),
    ("olé tus cojones", "es", 1.4), ("tu puta madre", "es", -1.0), ("THIS IS BAD!!!", None, -1.56), ("good yet bad but great", None, 1.5), ("good but bad yet great", None, 1.0), ("fucking great", None, 0.3), ("hardly good", None, -0.525),
    ("", None, 0.0), (None, None, 0.0), ("good?", None, 0.9), ("good " * 3000, "en", 2.0), ("a" * 200_000 + " good " + "❤️" * 50_000, "en", 1.0),
]


def test_scores(spark):
    rows = analyze_messages(spark.createDataFrame(SCORES, "text string, lang string, want double"), lang="lang").collect()
    assert {r.text: round(r.score, 9) for r in rows} == {t: w for t, _, w in SCORES}
    by = {r.text: r for r in rows}
    assert round(by["THIS IS BAD!!!"].intensity, 9) == 0.5 and by["good?"].intensity == 0.05
    assert not by["this is not good at all"].positive
    assert [(e.text, e.language) for e in by["qué coño es esto, no funciona una mierda"].profanity] == [("que cono", "es"), ("mierda", "es")]


def test_score_filters_stay_cheap(spark):
    df = analyze_messages(spark.createDataFrame(SCORES, "text string, lang string, want double"), lang="lang").where("score < -1").where(F.size("profanity") > 0)
    assert df.count() == 1
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 2_000_000


def _analyze(spark, text, cfg=None, lang=None):
    return analyze_messages(spark.createDataFrame([(text, lang)], "text string, lang string"), cfg, lang="lang").first()


def test_config(spark):
    own = L.Dictionary("xx", "positive", (("bad", 2.0), ("wow so", 1.2)))
    r = _analyze(spark, "WOW so bad", SentimentConfig(additional_dictionaries=[own]), "fr")
    assert round(r.score, 9) == 2.0 and [e.text for e in r.positive] == ["wow so", "bad"]
    r = _analyze(spark, "very bad!", SentimentConfig(enable_rules=False))
    assert (r.score, r.intensity) == (-1.0, 0.0)
    r = _analyze(spark, "very bad!", SentimentConfig(enable_keywords=False))
    assert (r.score, r.intensity, r.frustration) == (0.0, 0.0, [])


def test_fallback_and_model(spark):
    cfg = SentimentConfig(fallback=lambda text, lang: F.when(text.contains("null"), None).otherwise(F.lit(1.5)))
    assert _analyze(spark, "something plain", cfg).score == 0.75
    assert _analyze(spark, "git push", cfg).score == 0.0  # guarded
    assert _analyze(spark, "null thing here", cfg).score == 0.0
    assert _analyze(spark, "good", cfg).score == 1.0  # keywords first
    from tonelake.operators.models import text_model

    cfg = SentimentConfig(enable_model=True, model=text_model(lambda texts: [None if "none" in t else -0.5 for t in texts]))
    assert _analyze(spark, "one two three four five six seven eight", cfg).score == -0.5
    assert _analyze(spark, "one two three four five six seven none", cfg).score == 0.0
    assert _analyze(spark, "too short for it", cfg).score == 0.0


NEUTRAL = ["delete", "kill the process", "run the tests", "git push --hard", "ok", "abort", "make it", "borra el fichero temporal", "drop database", "commit"]


def test_neutral_commands(spark):
    rows = with_tokens(spark.createDataFrame([(t,) for t in NEUTRAL], "text string"), lang=None)
    assert all(r.g for r in rows.select(guard.technical(F.col("text"), F.col("norm")).alias("g")).collect())
    assert all(r.score == 0 for r in analyze_messages(spark.createDataFrame([(t,) for t in NEUTRAL], "text string")).collect())


def test_clashing_columns(spark):
    df = spark.createDataFrame([("good", "a", "b", 3, 4)], "text string, raw string, norm string, matches int, score int")
    r = analyze_messages(df).first()
    assert (r.raw, r.norm, r.matches, r.score) == ("a", "b", 3, 1.0)


def test_tokens(spark):
    df = spark.createDataFrame([("a ❤️ b x❤️y ótimo doesn't ABC好 好好 ABC1 12 Straße ﬁn １２",)], "text string")
    r = df.select(pieces(F.col("text")).alias("p"), folded_tokens(raw_tokens(F.col("text"))).alias("f"), F.filter(raw_tokens(F.col("text")), is_caps).alias("c")).first()
    assert r.p == ["a", "❤️", "b", "x❤️y", "ótimo", "doesn", "t", "ABC好", "好", "好", "ABC1", "12", "Straße", "ﬁn", "１２"] == L.pieces(df.first().text)
    assert r.f == ["a", "❤", "b", "x❤y", "otimo", "doesn", "t", "abc好", "好", "好", "abc1", "12", "strasse", "fin", "12"] and r.c == ["ABC好", "ABC1"]


def test_fold_agrees_with_unicode(spark):
    words = [e.text for e in L.builtin().entries] + ["ÀÉÎÕÜ", "éö", "ŞĞİ", "ẞ", "ΑΣ", "ﬀ", "Ｆｕｌｌ", "ñandú", "Ж", "ø"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", fold(F.col("w")).alias("f")).collect()
    assert [(r.w, r.f) for r in rows if r.f != L.fold(r.w)] == []


def simulate(text, lang, lex):
    """An independent, direct reading of the semantics."""
    raw = [x for x in (L.segment(L.pieces(text), lex.words) if lang == "zh" else L.pieces(text)) if L.fold(x)]
    norm, taken, found = [L.fold(x) for x in raw], set(), []
    for r in lex.ranked:
        if lang is None or r.entry.lang == lang or r.entry.any_lang:
            for i in range(len(norm) - len(r.tokens) + 1):
                span = set(range(i, i + len(r.tokens)))
                if not span & taken and tuple(norm[i : i + len(r.tokens)]) == r.tokens:
                    taken |= span
                    found.append((i, i + len(r.tokens) - 1, r.entry))
    found.sort(key=lambda m: m[0])
    if not found:
        return 0.0, 0.0, []
    ordered = {role: sorted(lex.role(role).phrases, key=lambda p: (-len(p), [-ord(c) for c in " ".join(p)] + [1])) for role in ("negation", "intensifier", "diminisher", "conjunction")}

    def before(role, start, distance):
        for p in ordered[role]:
            for a in range(max(0, start - distance), start - len(p) + 1):
                if tuple(norm[a : a + len(p)]) == p:
                    return p
        return None

    turn = None
    for p in ordered["conjunction"]:
        for a in range(len(norm) - len(p) + 1):
            if tuple(norm[a : a + len(p)]) == p:
                turn = a
    factors, total, intensity, seen = lex.role("intensifier").factors, 0.0, 0.0, []
    for s, e, entry in found:
        x = entry.score
        if before("negation", s, 2):
            x *= -0.75
        else:
            seen.append(entry.text)
        strong = before("intensifier", s, 2)
        if strong:
            x *= factors.get(" ".join(strong), 1.3)
        if before("diminisher", s, 3):
            x *= 0.7
        if turn is not None and s > turn:
            x *= 1.5
        if all(len(t) >= 2 and t == t.upper() and t != t.lower() for t in raw[s : e + 1]):
            x *= 1.2
            intensity += 0.2
        total += x
    loud = min(0.4, text.count("!") * 0.1)
    total, intensity = total * (1 + loud), intensity + loud
    if "?" in text:
        total, intensity = total * 0.9, intensity + 0.05
    return max(-2, min(2, total)), min(1, intensity), seen


def test_against_simulation(spark):
    lex, rng = L.builtin(), random.Random(5)
    phrases = [e.text for e in lex.entries] + [p for p, *_ in lex.modifiers]
    rows = []
    for i in range(1500):
        words = [rng.choice(phrases) if rng.random() < 0.7 else rng.choice(["x", "la", "foo", "好", "de"]) for _ in range(rng.randint(0, 9))]
        words = [w.upper() if rng.random() < 0.2 else w for w in words]
        rows.append((i, rng.choice([" ", ", ", "! "]).join(words) + rng.choice(["", "!", "?", "!?!!!!"]), rng.choice([None, *L.LANGUAGES, "ja"])))
    got = analyze_messages(spark.createDataFrame(rows, "id int, text string, lang string").repartition(4), lang="lang").collect()
    for r in got:
        score, intensity, seen = simulate(r.text, rows[r.id][2], lex)
        assert (round(r.score, 9), round(r.intensity, 9)) == (round(score, 9), round(intensity, 9)), r
        assert sorted(e.text for e in [*r.profanity, *r.frustration, *r.positive]) == sorted(seen), r


def test_join_form_gives_the_same(spark):
    lex = L.builtin()
    df = spark.createDataFrame([(i, e.text + " " + lex.entries[-i - 1].text, None) for i, e in enumerate(lex.entries)], "key int, text string, lang string")
    tokens = with_tokens(df)
    joined = match.found_by_join(tokens, match.lexicon_table(spark, lex)).select("key", match.without_overlap(F.col("candidates")).alias("j"))
    both = with_matches(tokens, SentimentConfig()).join(joined, "key")
    assert both.count() == 518 and both.where("to_json(matches) <> to_json(j)").count() == 0


def test_rank_limit_of_literals(spark):
    assert rules.Rules.of(L.builtin()).negation.longest == 3
    big = L.Lexicon(tuple(L.Entry("en", "positive", f"w{i}", 1.0) for i in range(match.MOST_LITERAL + 1)), (), frozenset())
    with pytest.raises(ValueError):
        match.found(F.col("norm"), F.col("lang"), big)


def test_session_metrics(spark):
    e = "array<struct<text:string,type:string,language:string>>"
    rows = spark.createDataFrame(
        [(1, 0, -1.0, 0.0, [("mierda", "profanity", "es")], [], [], "es"), (1, 1, 1.0, 0.0, [], [], [("genial", "positive", "es")], "es"), (1, 2, -0.5, 0.0, [], [], [], "en")],
        f"conv_id int, turn int, score double, intensity double, profanity {e}, frustration {e}, positive {e}, language string",
    )
    m = analyze.session_metrics(rows, "conv_id", "turn")
    r = m.first()
    assert (r.mean_score, r.stddev, r.angry_index, r.patience, r.language) == (-0.16666666666666666, 0.8498365855987975, 1 / 3, 1, "es")
    assert [tuple(x) for x in r.top_expressions] == [("genial", "positive", "es", 1), ("mierda", "profanity", "es", 1)]
    full = analyze.with_empty_sessions(m, spark.createDataFrame([(1,), (2,)], "conv_id int")).orderBy("conv_id").collect()
    assert (full[1].n_messages, full[1].mean_score, full[1].patience, full[1].language, full[1].top_expressions) == (0, 0.0, 0, None, [])
    new = analyze.override_mean(m, spark.createDataFrame([(1, 9.0)], "conv_id int, mean_score double")).first()
    assert new.mean_score == 2.0 and new.stddev == r.stddev


def test_sessions_fill_in_languages(spark):
    talk = [(7, i, t) for i, t in enumerate(["esto es lo que no funciona para nada", "mierda", "ok", "por que no", None])]
    r = analyze.analyze_sessions(spark.createDataFrame(talk, "conv_id int, turn int, text string")).first()
    assert (r.n_messages, r.language) == (5, "es") and r.patience >= 1


@pytest.mark.parametrize(
    "text, want",
    [("esto es lo que no funciona", "es"), ("this is what we have to do", "en"), ("isso não é o que eu queria", "pt"), ("das ist nicht gut für uns", "de"), ("ce n est pas ce que je voulais", "fr"), ("太好了", "zh"), ("short text", None), ("", None), (None, None)],
)
def test_language(spark, text, want):
    assert language.detect(spark.createDataFrame([(text,)], "text string")).first().lang == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "conv_id int, turn int, text string")
    assert analyze_messages(empty).count() == 0 and analyze.analyze_sessions(empty).count() == 0


def test_segments_agree_with_words(spark):
    """Neighbours joined as the lexicon's own function does it: words of more than four characters, in mixed tokens, with marks, and the character that cuts."""
    words = frozenset({"太好", "太好了", "好了", "一帆风顺", "了一", "他妈的", "妈的", "a好了b一", "好ab", "1他妈的太好", "\U00020000好", "", "了"})
    rng = random.Random(7)
    texts = ["".join(rng.choices(["太", "好", "了", "一", "帆", "风", "顺", "他", "妈", "的", "a", "b", "1", " ", "。", "́", "\x01", "\x01́", "\n", "\U00020000"], k=rng.randrange(1, 60))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", raw_tokens(F.col("text"), F.lit("zh"), words).alias("got"), raw_tokens(F.col("text"), F.lit("zh"), frozenset()).alias("none")).collect()
    ideographs = [r for r in rows if any("一" <= c <= "鿿" or c == "\U00020000" for c in r.text)]
    assert len(ideographs) > 1800 and any(len(x) > 4 for r in ideographs for x in r.got)
    assert [(r.text, r.got) for r in ideographs if r.got != L.segment(L.pieces(r.text), words)] == []
    assert [r.text for r in ideographs if r.none != L.pieces(r.text)] == []


def test_long_ideographs_take_little_time(spark):
    """The time follows the length: cut into words, 40,000 characters take as long as a page."""
    row = spark.createDataFrame([("这太好了，一帆风顺" * 5000, "zh")], "text string, lang string").select(F.size(raw_tokens(F.col("text"), F.col("lang"))).alias("n"))
    began = time.monotonic()
    assert row.first().n == 15000 and time.monotonic() - began < 30


def test_join_holds_few_tokens_a_row(spark):
    """What the join sends grows with a message's length, not with its square, and Spark knows that the lexicon is small."""
    lex = match.lexicon_table(spark, L.builtin())
    assert lex._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 256 << 10
    long_ = spark.createDataFrame([(1,), (2,)], "key long").select("key", F.lit("en").alias("lang"), F.array_repeat(F.lit("bad"), 20_000).alias("norm"))
    found = match.found_by_join(long_, lex)
    began = time.monotonic()
    assert [r.n for r in found.select(F.size("candidates").alias("n")).collect()] == [20_000] * 2 and time.monotonic() - began < 60
    assert match.found_by_join(long_, lex.limit(0)).count() == 0
