"""Words of Arrow text batches as 64-bit hashes, in NumPy."""

from __future__ import annotations

import unicodedata

import numpy as np

from .common import utf8

_R = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(32)

#: A word is a run of letters, digits and marks; ASCII case is folded. Spaces, punctuation, controls and ASCII symbols separate. Each character of a script that is
#: written without spaces (ideographs, kana, Thai, Lao, Tibetan, Burmese, Khmer) is a word of its own, as is each non-ASCII symbol.
_ALONE = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
_JOINERS = (0xAD, 0x200C, 0x200D)  # soft hyphen, zero-width (non-)joiner: within words
_classes: list[np.ndarray] = []
_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += np.uint8(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit words."""
    x = (x ^ (x >> _S)) * _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> _S
    return x


def fold(text: str) -> str:
    """What counts as the same text to ``word_hashes``: ASCII case folded; and by str.lower, which callers apply in the JVM, all other case."""
    return text.lower()


def _class() -> np.ndarray:
    """Of each code point: 0 separates, 1 is part of a word, 2 is a word of its own."""
    if not _classes:
        kind = [unicodedata.category(chr(c)) for c in range(0x110000)]
        out = np.array([0 if k[0] in "PZ" or k in ("Cc", "Cf") else 2 if k[0] == "S" else 1 for k in kind], np.uint8)
        for a, b in _ALONE:
            out[a : b + 1][out[a : b + 1] == 1] = 2
        out[list(_JOINERS)] = 1
        _classes.append(out)
    return _classes[0]


def _beyond_ascii(b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sets w, whether a byte is of a word, at the bytes of non-ASCII characters; the places where a word that is one character begins or ends."""
    cuts = []
    for n, low, high, bits in ((2, 0xC2, 0xE0, 0x1F), (3, 0xE0, 0xF0, 0x0F), (4, 0xF0, 0xF5, 0x07)):
        at = np.flatnonzero((b >= low) & (b < high))
        at = at[at + n <= len(b)]
        code = b[at].astype(np.int64) & bits
        for k in range(1, n):
            code = code << 6 | (b[at + k] & 0x3F)
        kind = _class()[np.minimum(code, 0x10FFFF)]
        for k in range(n):
            w[at + k] = kind > 0
        cuts += [at[kind == 2], at[kind == 2] + n]
    return np.concatenate(cuts)


_BLOCK = 1 << 22
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the low k bytes of a load


def loads(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, as numbers; past the end they are 0."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw) + 1, "<u8", buffer=padded, strides=(1,))


def slice_hashes(eight: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte slices start:end of the bytes that ``loads`` was given. Eight bytes at a time are mixed into what came before, so no
    sum over places is involved: slices that any polynomial hash confuses (Thue-Morse words and their complements) differ."""
    size = end - start
    h = mix((eight[start] & _LOW[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _R))
    k, more = 8, np.flatnonzero(size > 8)
    while len(more):
        left = size[more] - k
        h[more] = mix(mix(eight[start[more] + k] & _LOW[np.minimum(left, 8)]) + h[more] * _R)
        k += 8
        more = more[left > 8]
    return h


def same_slices(eight: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> bool:
    """Whether all slices start:end have the bytes of their slices other:other_end."""
    size = end - start
    if not np.array_equal(size, other_end - other):
        return False
    k, more = 0, np.flatnonzero((start != other) & (size > 0))
    while len(more):
        low = _LOW[np.minimum(size[more] - k, 8)]
        if ((eight[start[more] + k] ^ eight[other[more] + k]) & low).any():
            return False
        k += 8
        more = more[size[more] > k]
    return True


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the batch, and the number of words of each text. Null has no words."""
    raw, at = utf8(column)
    n = len(at) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    out, counts = [], np.zeros(n, np.int64)
    i = 0
    while i < n:  # blocks of whole texts, so that the scratch arrays stay small
        j = max(i + 1, int(np.searchsorted(at, at[i] + _BLOCK, "right")) - 1)
        j = min(j, n)
        b, off = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i0, i = i, j
        if not len(b):
            continue
        w = _WORD[b]
        alone = _beyond_ascii(b, w) if b.max() > 127 else np.zeros(0, np.int64)
        edge = np.empty(len(b) + 1, bool)
        edge[0], edge[-1] = w[0], w[-1]
        np.not_equal(w[1:], w[:-1], out=edge[1:-1])
        inner = np.concatenate([off[1:-1], alone])
        inner = inner[(inner > 0) & (inner < len(b))]
        joined = np.unique(inner[w[inner] & w[inner - 1]])  # one text's last word touches the next one's first, or one character's its neighbour
        cuts = np.flatnonzero(edge)
        if len(joined):
            cuts = np.sort(np.concatenate([cuts, joined, joined]))
        start, end = cuts[0::2], cuts[1::2]
        if not len(start):
            continue
        out.append(slice_hashes(loads(_FOLD[b]), start, end))
        counts[i0:j] = np.diff(np.searchsorted(start, off))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), counts
