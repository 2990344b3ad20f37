"""Contextual rules: negation, intensifiers, diminishers, the turn after a conjunction, capitals, exclamation and question marks.

The modifiers of all languages apply to every message, whatever its language.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_caps
from ..lexicon import DEFAULT_FACTOR, Lexicon, Phrases
from .match import places

NEGATED, DIMINISHED, TURNED, CAPITALS, QUESTION = -0.75, 0.7, 1.5, 1.2, 0.9
NEAR, FAR = 2, 3


@dataclass(frozen=True)
class Rules:
    negation: Phrases
    intensifier: Phrases
    diminisher: Phrases
    conjunction: Phrases

    @classmethod
    def of(cls, lexicon: Lexicon) -> Rules:
        return cls(*(lexicon.role(r) for r in ("negation", "intensifier", "diminisher", "conjunction")))


def grams_before(norm: Column, start: Column, distance: int, longest: int) -> Column:
    """All phrases of up to ``longest`` tokens within the last ``distance`` tokens before start."""
    lo = F.greatest(F.lit(0), start - distance)
    size = start - lo
    sizes = range(1, min(distance, longest) + 1)

    def of(n: int) -> Column:
        at = places(size - (n - 1))
        return F.transform(at, lambda i: F.array_join(F.slice(norm, lo + i + 1, n), " "))

    return F.concat(*(of(n) for n in sizes)) if sizes else F.array().cast("array<string>")


def _any(grams: Column, texts: Iterable[str]) -> Column:
    texts = list(texts)
    return F.exists(grams, lambda g: g.isin(texts)) if texts else F.lit(False)


def _words(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def negated(norm: Column, start: Column, rules: Rules) -> Column:
    return _any(grams_before(norm, start, NEAR, rules.negation.longest), rules.negation.texts)


def intensity_factor(norm: Column, start: Column, rules: Rules) -> Column:
    """Of the intensifiers before start, that of the most words and then the greatest text decides. Without any factor in the lexicon, none amplifies."""
    own = rules.intensifier
    if not own.factors:
        return F.lit(1.0)
    known = F.filter(grams_before(norm, start, NEAR, own.longest), lambda g: g.isin(own.texts))
    first = F.array_max(F.transform(known, lambda g: F.struct(_words(g).alias("n"), g.alias("text"))))["text"]
    special = F.create_map(*(x for t, f in sorted(own.factors.items()) for x in (F.lit(t), F.lit(float(f)))))
    return F.when(first.isNull(), 1.0).otherwise(F.coalesce(F.element_at(special, first), F.lit(DEFAULT_FACTOR)))


def diminished(norm: Column, start: Column, rules: Rules) -> Column:
    return _any(grams_before(norm, start, FAR, rules.diminisher.longest), rules.diminisher.texts)


def turning_point(norm: Column, rules: Rules) -> Column:
    """Where the deciding conjunction begins, or null: the phrase of the fewest words and then the least text, at its last place."""
    firsts = sorted({p[0] for p in rules.conjunction.phrases})
    if not firsts:
        return F.lit(None).cast("int")
    hits = F.filter(places(F.size(norm)), lambda i: F.get(norm, i).isin(firsts))
    sizes = sorted({len(p) for p in rules.conjunction.phrases})
    by_size = {n: sorted(" ".join(p) for p in rules.conjunction.phrases if len(p) == n) for n in sizes}

    def of(n: int) -> Column:
        some = F.filter(hits, lambda i: F.array_join(F.slice(norm, i + 1, n), " ").isin(by_size[n]) & (i + n <= F.size(norm)))
        return F.transform(some, lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(norm, i + 1, n), " ").alias("text"), (-i).alias("back")))

    return -F.array_min(F.concat(*(of(n) for n in sizes)))["back"]


def all_caps(raw: Column, m: Column) -> Column:
    return F.forall(F.slice(raw, m["start"] + 1, m["end"] - m["start"] + 1), is_caps)


def adjusted(matches: Column, norm: Column, raw: Column, turn: Column, rules: Rules) -> Column:
    """The matches with what the rules make of each: negated, caps and adjusted (its score)."""

    def one(m: Column) -> Column:
        no, caps, start = negated(norm, m["start"], rules), all_caps(raw, m), m["start"]
        score = m["score"] * F.when(no, NEGATED).otherwise(1.0) * intensity_factor(norm, start, rules) * F.when(diminished(norm, start, rules), DIMINISHED).otherwise(1.0)
        score = score * F.when(start > turn, TURNED).otherwise(1.0) * F.when(caps, CAPITALS).otherwise(1.0)
        return F.struct(*(m[c].alias(c) for c in ("start", "end", "text", "type", "lang", "score")), no.alias("negated"), caps.alias("caps"), score.alias("adjusted"))

    return F.transform(matches, one)


def _total(ruled: Column, part) -> Column:
    return F.aggregate(ruled, F.lit(0.0), lambda acc, m: acc + part(m))


def exclamation(text: Column) -> Column:
    return F.least(F.lit(0.4), (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) * 0.1)


def message_score(ruled: Column, text: Column) -> Column:
    """Not yet clamped; 0 without matches."""
    return _total(ruled, lambda m: m["adjusted"]) * (1 + exclamation(text)) * F.when(text.contains("?"), QUESTION).otherwise(1.0)


def message_intensity(ruled: Column, text: Column) -> Column:
    raised = _total(ruled, lambda m: F.when(m["caps"], 0.2).otherwise(0.0)) + exclamation(text) + F.when(text.contains("?"), 0.05).otherwise(0.0)
    return F.when(F.size(ruled) > 0, F.least(F.lit(1.0), raised)).otherwise(0.0)
