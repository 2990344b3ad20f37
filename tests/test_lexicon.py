import pytest

from tonelake import lexicon as L
from tonelake.sources.dictionaries import dictionary_rows, unfolded

HEAD = "# language: xx\n# type: positive\n"


@pytest.mark.parametrize(
    "content, kind",
    [
        ("# type: positive\nok\t1", "missing_language"), ("# language: xx\nok\t1", "missing_type"), ("# language: xx\n# type: odd\nok\t1", "invalid_type"), (HEAD + "ok 1", "missing_separator"),
        (HEAD + "ok\tone", "invalid_score"), (HEAD + "ok\tinf", "invalid_score"), (HEAD + "ok\t1\nOK\t2", "duplicate_expression"), (HEAD + "é\t1\né\t2", "duplicate_expression"),
    ],
)
def test_errors(spark, content, kind):
    with pytest.raises(L.LexiconError) as e:
        L.parse_dictionary(content)
    assert e.value.kind == kind
    found = {r.error for r in dictionary_rows(spark.createDataFrame([("f", content)], "path string, value string")).collect()}
    assert found - {None} == {kind}


def test_parse(spark):
    content = "# note\n# type: profanity\n# type: positive\n#language:xx\n\n  Muy  Bién \t 1.5 \nso so\t-0.5\n"
    d = L.parse_dictionary(content)
    assert (d.lang, d.type, d.entries) == ("xx", "positive", (("muy bien", 1.5), ("so so", -0.5)))
    rows = dictionary_rows(spark.createDataFrame([("f", content)], "path string, value string")).orderBy("ord").collect()
    assert [(r.lang, r.type, r.expression, r.score, r.error) for r in rows] == [("xx", "positive", "muy bien", 1.5, None), ("xx", "positive", "so so", -0.5, None)]


def test_insert():
    d = L.builtin_dictionaries()[0]
    assert L.insert(d, "Ñandú", -1).entries[-1] == ("nandu", -1.0)
    with pytest.raises(L.LexiconError):
        L.insert(d, d.entries[0][0].upper(), -1)
    with pytest.raises(L.LexiconError):
        L.insert(L.Dictionary("ja", "positive", ()), "x", 1)


def test_builtin_is_folded_and_ranked(spark):
    b = L.builtin()
    assert len(b.entries) == 518 and len(L.builtin_dictionaries()) == 18
    assert all(L.fold_expression(e.text) == e.text for e in b.entries)
    assert not unfolded(spark.createDataFrame([(e.text,) for e in b.entries], "expression string")).count()
    keys = [(-len(r.tokens), -len(r.entry.text)) for r in b.ranked]
    assert keys == sorted(keys)
    first = [r.entry for r in b.ranked if r.tokens == ("horrible",)]
    assert (first[0].lang, first[0].score) == ("es", -1.0)
    assert [len(b.role(r).phrases) for r in ("negation", "intensifier", "diminisher", "conjunction")] == [74, 62, 37, 29]


def test_modifiers_longer_than_their_window():
    b = L.builtin()
    assert [p for p in b.role("negation").phrases if len(p) > 2] == [("de", "jeito", "nenhum")]


@pytest.mark.parametrize("raw, want", [("太好了", ["太好了"]), ("非常棒", ["非常棒"]), ("不好", ["不好"]), ("这是词", ["这", "是", "词"]), ("一二三四五", list("一二三四五")), ("", [])])
def test_segment(raw, want):
    words = frozenset(["太好了", "非常棒", "不好", "非常", "一二三四五"])
    assert L.segment(list(raw), words) == want


def test_phrase_files(tmp_path):
    from tonelake import lexicon

    path = tmp_path / "es-intensifiers.tsv"
    path.write_text("# said strongly\n\nmuy\t1.5\nde verdad\nbastante\tnot a number\n")
    rows = lexicon.read_phrases(str(path), "intensifier")
    assert rows == (("muy", "es", "intensifier", 1.5), ("de verdad", "es", "intensifier", None), ("bastante", "es", "intensifier", None))
    more = lexicon.builtin().with_phrases((("zzz top", "es", "intensifier", 2.0),)).role("intensifier")
    assert ("zzz", "top") in more.phrases and more.factors["zzz top"] == 2.0
    with pytest.raises(lexicon.LexiconError):
        lexicon.parse_phrases("x", "", "negation")
