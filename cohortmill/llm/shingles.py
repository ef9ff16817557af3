"""Word shingles as sets of 64-bit hashes, computed for many texts at once in NumPy.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased: exactly what bytes.lower() and a
scan for those six bytes give on UTF-8. A word's hash is a sum over its bytes, a shingle's hash a
sum over its words' hashes, each mixed to 64 bits, so that no shingle string is ever built.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_PLACE = mix64(np.arange(1, 33, dtype=np.uint64) * _U(0xD1342543DE82EF95)) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n + 1023, _BASE, np.uint64))])
    return _POWERS


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and where each text's words begin (one more than texts)."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    raw = [r.lower() for r in raw] if lower else raw
    buf = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    sep = _SEP[buf]
    starts = np.flatnonzero(~sep & np.concatenate([[True], sep[:-1]]))
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    ends = np.flatnonzero(sep & np.concatenate([[False], ~sep[:-1]]))
    length = ends - starts
    place = np.zeros(len(buf), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf))))
    place = np.where(sep, 0, place)
    value = _BYTE[buf] * _powers(int(length.max()) + 1)[place]
    value[sep] = 0
    return mix64(np.add.reduceat(value, starts) + length.astype(np.uint64)), np.searchsorted(starts, at)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles of `width` words; a shorter text with words
    is one shingle, the whole sequence; a text without words (or null) has the empty set."""
    words, at = word_hashes(texts)
    n = len(words)
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width):
        whole += words[j : n - width + 1 + j] * _PLACE[j]
    whole = mix64(whole + _U(width))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        k = b - a
        if k >= width:
            out.append(np.unique(whole[a : b - width + 1]))
        elif k:
            out.append(mix64((words[a:b] * _PLACE[:k]).sum(dtype=np.uint64, keepdims=True) + _U(k)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def in_pieces(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` characters each, so that the arrays of a piece stay small."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
