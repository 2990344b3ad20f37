"""Expression dictionaries and modifier phrases: built-in tables, parsing, validation, ranking.

A lexicon is small and lives on the driver; operators embed it in their plans as literals, or join with it as a table (see operators/match.py).
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from importlib.resources import files

TYPES = ("profanity", "frustration", "positive")
LANGUAGES = ("es", "en", "pt", "de", "fr", "zh")
DEFAULT_FACTOR = 1.3

IDEOGRAPHS = "\U0002b820-\U0002ceaf\U0002b740-\U0002b81f\U0002a700-\U0002b73f\U00020000-\U0002a6df\U0002f800-\U0002fa1f豈-﫿㐀-䶿一-鿿"


class LexiconError(ValueError):
    """kind: missing_language, missing_type, invalid_type, missing_separator, empty_expression, invalid_score or duplicate_expression."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {detail}" if detail else kind)
        self.kind, self.detail = kind, detail


def fold(word: str) -> str:
    """The form in which words are compared: compatibility form, without case, marks and width."""
    flat = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", word).casefold())
    return unicodedata.normalize("NFC", "".join(c for c in flat if unicodedata.category(c) != "Mn"))


def fold_expression(text: str) -> str:
    """An expression with every word folded, words joined by one blank; punctuation stays."""
    return " ".join(fold(w) for w in text.split())


def _is_word(c: str) -> bool:
    return unicodedata.category(c)[0] in "LMN"


def pieces(text: str) -> list[str]:
    """Runs of letters, marks and digits; another character counts with a mark that follows it. Pure ideograph runs fall apart into characters."""
    found, i = [""], 0
    while i < len(text):
        if _is_word(text[i]):
            found[-1] += text[i]
        elif i + 1 < len(text) and unicodedata.category(text[i + 1])[0] == "M":
            found[-1] += text[i : i + 2]
            i += 1
        elif found[-1]:
            found.append("")
        i += 1
    ideographs = re.compile(f"[{IDEOGRAPHS}]+")
    return [x for p in found if p for x in (list(p) if ideographs.fullmatch(p) else [p])]


def segment(raw: Sequence[str], words: frozenset[str]) -> list[str]:
    """Greedy longest join, from the left, of up to four neighbouring tokens that is a known word."""
    out, i = [], 0
    while i < len(raw):
        n = next((k for k in range(min(4, len(raw) - i), 0, -1) if "".join(raw[i : i + k]) in words), 1)
        out.append("".join(raw[i : i + n]))
        i += n
    return out


def word_tokens(text: str, lang: str | None, words: frozenset[str]) -> tuple[str, ...]:
    raw = pieces(text)
    return tuple(f for f in map(fold, segment(raw, words) if lang == "zh" else raw) if f)


@dataclass(frozen=True)
class Entry:
    lang: str
    type: str
    text: str
    score: float
    any_lang: bool = False


@dataclass(frozen=True)
class Dictionary:
    """Entries of one language and type, folded and checked on construction."""

    lang: str
    type: str
    entries: tuple[tuple[str, float], ...]

    def __post_init__(self) -> None:
        if not self.lang:
            raise LexiconError("missing_language")
        if self.type not in TYPES:
            raise LexiconError("invalid_type", self.type)
        seen: set[str] = set()
        folded = []
        for text, score in self.entries:
            key = fold_expression(text)
            if not key:
                raise LexiconError("empty_expression")
            if not math.isfinite(score):
                raise LexiconError("invalid_score", text)
            if key in seen:
                raise LexiconError("duplicate_expression", key)
            seen.add(key)
            folded.append((key, float(score)))
        object.__setattr__(self, "entries", tuple(folded))

    def rows(self, any_lang: bool = False) -> list[Entry]:
        return [Entry(self.lang, self.type, t, s, any_lang) for t, s in self.entries]


def parse_dictionary(content: str) -> Dictionary:
    """A dictionary in its text form: ``# language:`` and ``# type:`` lines (the last one counts), then expression, tab, score."""
    meta: dict[str, str] = {}
    entries = []
    for line in map(str.strip, re.split(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]", content)):
        if line.startswith("#"):
            name, colon, value = line[1:].partition(":")
            if colon:
                meta[name.strip()] = value.strip()
        elif line:
            text, tab, score = line.partition("\t")
            if not tab:
                raise LexiconError("missing_separator", line)
            if not text.strip():
                raise LexiconError("empty_expression", line)
            try:
                entries.append((text.strip(), float(score.strip())))
            except ValueError:
                raise LexiconError("invalid_score", line) from None
    for name in ("language", "type"):
        if not meta.get(name):
            raise LexiconError(f"missing_{name}")
    return Dictionary(meta["language"], meta["type"], tuple(entries))


def read_dictionary(path: str) -> Dictionary:
    with open(path, encoding="utf-8") as f:
        return parse_dictionary(f.read())


def parse_phrases(content: str, lang: str, role: str) -> tuple[tuple[str, str, str, float | None], ...]:
    """Modifier rows (phrase, language, role, factor) from text: a phrase a line, and after a tab, if it is a number, its factor. Blank lines and those that begin with # are skipped."""
    if not lang:
        raise LexiconError("missing_language")
    out = []
    for line in map(str.strip, content.splitlines()):
        if not line or line.startswith("#"):
            continue
        phrase, _, rest = line.partition("\t")
        try:
            factor = float(rest.split("\t")[0].strip())
        except ValueError:
            factor = None
        out.append((phrase.strip(), lang, role, factor if factor is not None and math.isfinite(factor) else None))
    return tuple(out)


def read_phrases(path: str, role: str) -> tuple[tuple[str, str, str, float | None], ...]:
    """The phrases of a file whose name begins with its language, as in ``es-negation.tsv``."""
    with open(path, encoding="utf-8") as f:
        return parse_phrases(f.read(), re.split(r"[-_.]", os.path.basename(path))[0], role)


def insert(dictionary: Dictionary, text: str, score: float) -> Dictionary:
    """The dictionary with one more expression at its end; an error if it is there already, or the language isn't a built-in one."""
    if dictionary.lang not in LANGUAGES:
        raise LexiconError("missing_language", dictionary.lang)
    return Dictionary(dictionary.lang, dictionary.type, (*dictionary.entries, (text, score)))


@dataclass(frozen=True)
class Ranked:
    """An entry as the matcher tries it: the lesser rank first."""

    rank: int
    tokens: tuple[str, ...]
    entry: Entry


@dataclass(frozen=True)
class Phrases:
    """Modifier phrases of one role, over all languages. factors: those that have one of their own."""

    phrases: frozenset[tuple[str, ...]]
    factors: dict[str, float] = field(default_factory=dict)

    @property
    def texts(self) -> list[str]:
        return sorted(" ".join(p) for p in self.phrases)

    @property
    def longest(self) -> int:
        return max(map(len, self.phrases), default=0)


@dataclass(frozen=True)
class Lexicon:
    entries: tuple[Entry, ...]
    modifiers: tuple[tuple[str, str, str, float | None], ...]  # phrase, lang, role, factor
    words: frozenset[str]

    @cached_property
    def ranked(self) -> list[Ranked]:
        """More tokens first, then the longer text, then the order of registration. Entries without a token never match."""
        both = [(word_tokens(e.text, e.lang, self.words), e) for e in self.entries]
        both.sort(key=lambda x: (-len(x[0]), -len(x[1].text)))  # stable
        return [Ranked(i, t, e) for i, (t, e) in enumerate(both) if t]

    def role(self, name: str) -> Phrases:
        own = [(word_tokens(p, lang, self.words), f) for p, lang, role, f in self.modifiers if role == name]
        return Phrases(frozenset(t for t, _ in own if t), {" ".join(t): f for t, f in own if f is not None})

    def extended(self, dictionaries: Iterable[Dictionary]) -> Lexicon:
        """With users' dictionaries after the others; their entries match in every language."""
        return Lexicon((*self.entries, *(e for d in dictionaries for e in d.rows(any_lang=True))), self.modifiers, self.words)

    def with_phrases(self, rows: Iterable[tuple[str, str, str, float | None]]) -> Lexicon:
        """With more modifier phrases, as ``read_phrases`` gives them."""
        return Lexicon(self.entries, (*self.modifiers, *rows), self.words)


def _table(name: str) -> list[list[str]]:
    return [line.split("\t") for line in (files("tonelake") / "data" / name).read_text(encoding="utf-8").splitlines()[1:]]


@lru_cache(maxsize=1)
def builtin() -> Lexicon:
    rows = sorted(_table("expressions.tsv"), key=lambda r: int(r[3]))
    modifiers = tuple((p, lang, role, float(f) if f else None) for p, lang, role, f in _table("modifiers.tsv"))
    entries = tuple(Entry(lang, kind, text, float(w)) for text, lang, kind, _, w in rows)
    words = {p for p, lang, role, _ in modifiers if lang == "zh" and role in ("word", "negation", "intensifier")} | {e.text for e in entries if e.lang == "zh"}
    return Lexicon(entries, modifiers, frozenset(words))


def builtin_dictionaries() -> list[Dictionary]:
    """The 18 dictionaries, in order of registration."""
    own = builtin().entries
    return [Dictionary(lang, kind, tuple((e.text, e.score) for e in own if (e.lang, e.type) == (lang, kind))) for lang in LANGUAGES for kind in TYPES]
