"""Periodic runs of words: maximal stretches that repeat with a period, and texts without the repeats.

A square ww whose next word breaks the period is found at the lcp interval of depth |w| in the enhanced suffix array
(suffix array, its inverse and lcp values): of an interval's children all but the largest are gone through, and for
each of their suffixes i the inverse tells whether i + depth or i - depth lies in the interval too. Such branching
squares, rotated to the left as far as the period holds, are the runs; no tree is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.shingles import in_pieces, mix64

RUNS = "array<struct<start: long, length: long, period: long>>"


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int32)


def block_ranks(s: np.ndarray) -> list[np.ndarray]:
    """Ranks of the blocks of 1, 2, 4, ... symbols at every place, up to where all differ; the last are the suffixes' ranks."""
    ranks, k = [_dense(s)], 1
    while int(ranks[-1].max()) < len(s) - 1:
        r = ranks[-1].astype(np.int64)
        ahead = np.zeros(len(s), np.int64)
        ahead[: len(s) - k] = r[k:] + 1
        ranks.append(_dense(r * (len(s) + 1) + ahead))
        k *= 2
    return ranks


def common_ahead(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from a on equal those from b on, for many pairs of places a, b (not equal)."""
    n, total = len(ranks[0]), np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        at, bt = a + total, b + total
        inside = np.maximum(at, bt) + (1 << j) <= n
        same = inside.copy()
        same[inside] = ranks[j][at[inside]] == ranks[j][bt[inside]]
        total += same.astype(np.int64) << j
    return total


def common_behind(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols before a equal those before b."""
    total = np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        at, bt = a - total - (1 << j), b - total - (1 << j)
        inside = np.minimum(at, bt) >= 0
        same = inside.copy()
        same[inside] = ranks[j][at[inside]] == ranks[j][bt[inside]]
        total += same.astype(np.int64) << j
    return total


def smaller_children(lcp: list[int]) -> np.ndarray:
    """Rows (depth, left, right, first, last): every lcp interval [left, right] of depth > 0 with each of its children
    [first, last] but the largest. lcp[k] is that of the suffixes of ranks k - 1 and k; lcp[0] is not read."""
    out, stack, n = [], [], len(lcp)
    for k in range(1, n + 1):
        depth, left = lcp[k] if k < n else 0, k - 1
        while stack and depth < stack[-1][0]:
            d, left, cuts = stack.pop()
            cuts.append(k)
            sizes = [b - a for a, b in zip(cuts, cuts[1:])]
            most = sizes.index(max(sizes))
            out += [(d, left, k - 1, a, b - 1) for c, (a, b) in enumerate(zip(cuts, cuts[1:])) if c != most]
        if depth and (not stack or depth > stack[-1][0]):
            stack.append((depth, left, [left, k]))
        elif depth:
            stack[-1][2].append(k)
    return np.array(out, np.int64).reshape(-1, 5)


def branching_squares(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(places, periods, block ranks) of the squares of s that don't go on with their period; s must end with a symbol of its own."""
    ranks = block_ranks(s)
    isa = ranks[-1].astype(np.int64)
    sa = np.empty(len(s), np.int64)
    sa[isa] = np.arange(len(s))
    lcp = [0, *common_ahead(ranks, sa[:-1], sa[1:]).tolist()]
    rows = smaller_children(lcp)
    many = rows[:, 4] - rows[:, 3] + 1
    depth, left, right = (np.repeat(rows[:, c], many) for c in range(3))
    i = sa[np.repeat(rows[:, 3] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    places, periods = [], []
    for low, high, at in ((i, i + depth, i + depth), (i - depth, i, i - depth)):
        ok = (at >= 0) & (at < len(s))
        ok[ok] = (isa[at[ok]] >= left[ok]) & (isa[at[ok]] <= right[ok])
        ok[ok] = s[high[ok]] != s[high[ok] + depth[ok]]
        places.append(low[ok])
        periods.append(depth[ok])
    return np.concatenate(places), np.concatenate(periods), ranks


def _repeated_stretches(s: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of places that a window of at least `width` symbols which occurs twice covers."""
    h, w = mix64(s.astype(np.uint64) + np.uint64(1)), 1
    while 2 * w <= width:
        h = mix64(h[: len(h) - w] * np.uint64(0x9E3779B97F4A7C15) + h[w:])
        w *= 2
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    step = np.zeros(len(s) + 1, np.int64)
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    step[twice] += 1
    np.add.at(step, twice + w, -1)
    inside = np.concatenate([[0], (np.cumsum(step[:-1]) > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(inside))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def runs_of(s: np.ndarray, least: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the symbols s that have at least `least` symbols and `exponent` (2 or
    more) periods, by start and period; the period is the smallest, and no neighbour continues it.

    A run of period q repeats at a distance of q all but q of its symbols, so that windows that occur twice cover it
    wholly; the suffix array is built over such stretches alone.
    """
    if len(s) < least:
        return []
    q = least // exponent
    width = max(1, min(least - q, (exponent - 1) * (q + 1)))
    stretches = [(a, b) for a, b in _repeated_stretches(s, width) if b - a >= least]
    if not stretches:
        return []
    # every stretch has symbols of its own and ends with one that occurs once: nothing matches across
    top, parts, origin = int(s.max()) + 1, [], []
    for k, (a, b) in enumerate(stretches):
        parts += [s[a:b].astype(np.int64) + k * top, [-1 - k]]
        origin += [np.arange(a, b + 1)]
    text, origin = np.concatenate(parts).astype(np.int64), np.concatenate(origin)
    place, period, ranks = branching_squares(text)
    back = common_behind(ranks, place, place + period)
    length = back + 2 * period
    keep = (length >= least) & (length >= exponent * period)
    found: dict[tuple[int, int], int] = {}
    for start, n, p in zip(origin[place - back][keep].tolist(), length[keep].tolist(), period[keep].tolist(), strict=True):
        found[start, n] = min(p, found.get((start, n), p))  # multiples of the period give the same stretch
    return sorted((start, n, p) for (start, n), p in found.items())


def _symbols(words: list[bytes]) -> np.ndarray:
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, count()), np.int64, len(words))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, exponent: int = 3) -> DataFrame:
    """Per row of docs: (id_col, n_words, runs, collapsed).

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0, compared as they are written. runs holds start, length and smallest
    period of every run of at least `least` words and `exponent` periods, by start and period. collapsed is the words
    joined by one space without those that any run holds after its first period.

    Null and empty texts: no words, no runs, collapsed empty. Null ids and repeated rows are rows as any other. Other
    columns of docs are not read, so clashing names do no harm. An empty table gives an empty result. Very long texts
    are read whole: memory goes with the length of one text, times the logarithm of its longest repeat.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["t"].tolist()
            for a, b in in_pieces(texts):
                many, found, left = [], [], []
                for t in texts[a:b]:
                    words = (t or "").encode("utf-8", "replace").split()  # bytes know these six blanks alone
                    runs = runs_of(_symbols(words), least, exponent)
                    if runs:
                        gone = np.zeros(len(words), bool)
                        for start, n, p in runs:
                            gone[start + p : start + n] = True
                        words = [w for w, x in zip(words, gone.tolist(), strict=True) if not x]
                    many.append(len(gone) if runs else len(words))
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    left.append(b" ".join(words).decode())
                yield pd.DataFrame({"id": pdf["id"].iloc[a:b].array, "n_words": np.array(many, np.int64), "runs": found, "collapsed": left})

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInPandas(run, f"id {kind}, n_words long, runs {RUNS}, collapsed string")
    return out.withColumnRenamed("id", id_col)
