"""Column expressions on text: tokens, folding, capitals. All run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import combinations, pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import IDEOGRAPHS, builtin

#: A piece is a run of word characters; any other character belongs to it together with a mark that follows.
#: So this is what parts them. Java's regular expressions recurse for repeated groups, and a piece may be as long as a text: there is none here.
SEPARATOR = r"[^a-z0-9A-Z\p{L}\p{M}\p{N}](?!\p{M})"
_CUT = "\x01"
#: A cut between tokens; before a mark, the character belongs to a token.
_BETWEEN = _CUT + r"(?!\p{M})"
_ENDS = rf"(?={_BETWEEN}|\z)"


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters, what each folds to, and the few that fold to several."""
    one, many = [], []
    for lo, hi in ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500), (0xFB00, 0xFB07), (0xFF01, 0xFFF0)):
        for c in map(chr, range(lo, hi)):
            if unicodedata.category(c)[0] not in "LN":
                continue
            flat = "".join(x for x in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", c).casefold()) if unicodedata.category(x) != "Mn")
            flat = unicodedata.normalize("NFC", flat)
            if len(flat) == 1 and flat != c:
                one.append((c, flat))
            elif c in "ßŉǆǉǌﬀﬁﬂﬃﬄﬅﬆ":
                many.append((c, flat))
    return "".join(c for c, _ in one), "".join(f for _, f in one), many


def fold(c: Column) -> Column:
    """Text without case, marks and width, character by character: what lexicon.fold does for the scripts of the built-in languages."""
    plain, folded, many = _folding()
    low = F.lower(c)
    out = F.translate(F.regexp_replace(low, r"\p{Mn}+", ""), plain, folded)
    for long_, short in many:
        out = F.replace(out, F.lit(long_), F.lit(short))
    return F.when(F.octet_length(c) == F.length(c), low).otherwise(out)  # ASCII has only case


def fold_expression(c: Column) -> Column:
    """Folded words joined by one blank."""
    return fold(F.trim(F.regexp_replace(c, r"\s+", " ")))


def has_ideograph(c: Column) -> Column:
    return (F.octet_length(c) > F.length(c)) & c.rlike(f"[{IDEOGRAPHS}]")


def pieces(text: Column) -> Column:
    """Raw tokens; null text has none."""
    found = F.coalesce(F.array_remove(F.split(text, SEPARATOR), ""), F.array().cast("array<string>"))
    single = F.flatten(F.transform(found, lambda p: F.when(p.rlike(f"^[{IDEOGRAPHS}]+$"), F.regexp_extract_all(p, F.lit("."), F.lit(0))).otherwise(F.array(p))))
    return F.when(has_ideograph(text), single).otherwise(found)


def _in_tokens(word: str, k: int) -> list[str]:
    """Regular expressions of the word cut into k tokens, one for each way to cut it."""
    chars = [f"\\x{{{ord(c):x}}}" for c in word]
    ways = combinations(range(1, len(chars)), k - 1)
    return [_BETWEEN.join("".join(chars[i:j]) for i, j in pairwise((0, *at, len(chars)))) for at in ways]


@lru_cache(maxsize=8)
def _joins(words: frozenset[str]) -> tuple[str, str] | None:
    """What finds two to four neighbours that are a word, the most of them first, and what puts them together. The look ahead bounds what the groups take."""
    ways, n = [], 0
    for k in (4, 3, 2):
        if cut := [x for w in sorted(words) for x in _in_tokens(w, k)]:
            ways.append(f"(?=(?:{'|'.join(cut)}){_ENDS})" + _BETWEEN.join([f"([^{_CUT}]+)"] * k))
            n += k
    return (f"(?:^|(?<={_CUT})(?!\\p{{M}}))(?:{'|'.join(ways)}){_ENDS}", "".join(f"${i + 1}" for i in range(n))) if ways else None


def segmented(raw: Column, words: frozenset[str]) -> Column:
    """Greedy longest join of up to four neighbouring tokens that is a known word, from the left; the whole list is read once, as one string."""
    joins = _joins(words)
    if joins is None:
        return raw
    return F.array_remove(F.split(F.regexp_replace(F.array_join(raw, _CUT), *joins), _BETWEEN), "")


def raw_tokens(text: Column, lang: Column | None = None, words: frozenset[str] | None = None) -> Column:
    """Raw tokens, segmented where lang is zh."""
    raw = pieces(text)
    if lang is None:
        return raw
    return F.when((lang == "zh") & has_ideograph(text), segmented(raw, builtin().words if words is None else words)).otherwise(raw)


def folded_tokens(raw: Column) -> Column:
    """Each raw token folded; the whole list is folded as one string, not token by token. Some may be empty."""
    return F.when(F.size(raw) > 0, F.split(fold(F.array_join(raw, _CUT)), _CUT)).otherwise(F.array().cast("array<string>"))


def is_caps(raw: Column) -> Column:
    """Two characters or more, in capitals, and with a case."""
    return (F.length(raw) >= 2) & (raw == F.upper(raw)) & (raw != F.lower(raw))


def opaque(c: Column) -> Column:
    """c itself, but a filter on it stays above: pushed down, it would copy c's expression once for every use, at every level."""
    return F.when(F.spark_partition_id() >= 0, c)


def stripped(c: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
