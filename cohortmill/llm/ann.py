"""Approximate nearest neighbours by a hash-prefix forest (LSH forest, Bawa, Condie and Ganesan 2005).

A tree is the sorted array of its vectors' long hash strings; a query descends to the longest prefix it
shares with the array and all trees ascend together, symbol by symbol, until they hold enough candidates,
whose inner products are exact. A string's symbols are the signed axes that a randomly rotated vector is
nearest to (Andoni et al. 2015, cross-polytope hashing), the nearest first. Vectors of unlike norms lie in
bands of norm, each with forests of its own, and are extended by one component, so that the order of angles
is the order of inner products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.session import written

SYMBOLS, SYMBOL_BITS = 4, 16
#: Norms in a band differ by this factor at most; a band is centred on its powers.
BAND = 1.25


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v array<double>) of the vectors that take part: not null, no null or non-finite component, not zero."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ok)


def _rotations(seed: int, trees: int, size: int) -> Iterator[np.ndarray]:
    rng = np.random.default_rng(seed)
    for _ in range(trees):
        yield np.linalg.qr(rng.standard_normal((size, size)))[0].astype(np.float32)


def hash_strings(x: np.ndarray, extra: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Per vector and tree a string of SYMBOLS symbols as an unsigned integer; extra is the component that levels norms."""
    wide = np.column_stack([x, extra]).astype(np.float32)
    row, out = np.arange(len(wide)), np.zeros((len(wide), trees), np.uint64)
    for t, turn in enumerate(_rotations(seed, trees, wide.shape[1])):
        y = wide @ turn
        far = np.abs(y)
        for _ in range(SYMBOLS):
            axis = far.argmax(1)
            symbol = 2 * axis + (y[row, axis] > 0)
            out[:, t] = out[:, t] << np.uint64(SYMBOL_BITS) | symbol.astype(np.uint64)
            far[row, axis] = -1
    return out


def enough_of(rows: int, k: int) -> int:
    """Candidates at which the trees over so many rows stop: a falling share of the rows, by one formula at every size."""
    return min(rows, max(k + 1, math.ceil(1.3 * rows**0.82)))


class Forest:
    """Sorted hash strings of some vectors, tree by tree."""

    def __init__(self, strings: np.ndarray):
        self.order = np.argsort(strings, axis=0, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(strings, self.order, 0)

    def ranges(self, queries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree where the strings lie that share their first `depth` symbols with the query's."""
        span = np.uint64((1 << (SYMBOL_BITS * (SYMBOLS - depth))) - 1)
        low = queries & ~span
        first = [np.searchsorted(self.sorted[:, t], low[:, t]) for t in range(low.shape[1])]
        last = [np.searchsorted(self.sorted[:, t], low[:, t] | span, "right") for t in range(low.shape[1])]
        return np.array(first).T, np.array(last).T

    def candidates(self, queries: np.ndarray, enough: int) -> Iterator[np.ndarray]:
        """Per query the rows that share the longest prefixes in any tree: from whole strings on all trees ascend
        together, a symbol at a time; on the last level trees give their rows in turn until there are `enough`.
        Where one symbol shared in any tree is not enough, all rows are candidates."""
        n = len(self.sorted)
        levels = [self.ranges(queries, depth) for depth in range(SYMBOLS, 0, -1)]
        for i in range(len(queries)):
            found, have = np.zeros(n, bool), 0
            for low, high in levels:
                for t in np.flatnonzero(high[i] > low[i]):
                    found[self.order[low[i, t] : high[i, t], t]] = True
                    have = np.count_nonzero(found)
                    if have >= enough:
                        break
                if have >= enough:
                    break
            yield np.flatnonzero(found) if have >= enough else np.arange(n)


def nearest(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    trees: int = 128, shard_rows: int = 16384, block_rows: int = 4096, seed: int = 11,
) -> DataFrame:
    """Per query its k nearest vectors by inner product: (query_id, rank, vec_id, score, scored, held), nearest first, ties to smaller ids.

    Every vector is indexed: vectors are dealt by length, band of norm and hash of id into shards of about
    `shard_rows`, each with a forest of its own, and queries visit all shards of their length in blocks of about
    `block_rows`. A shard's trees ascend until they hold enough_of(its rows) candidates, and only those are
    multiplied, in double precision with the original vectors; scored counts those of the neighbour's shard, which
    holds `held` vectors. A shard gives
    its k best of a query, a merge the k best of all.

    The query itself is no candidate. Vectors that are null, zero or hold null or non-finite components take no
    part, as query or candidate; of repeated ids any one row counts. Vectors of unlike length have no inner
    product: a query meets those of its own length. Equal vectors tie and share all strings, so a group of them in a
    shard is found whole. An empty table gives an empty result. queries: rows of the same columns; all vectors by default.
    """
    band = F.round(F.log(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)) / (2 * math.log(BAND))).cast("int")
    rows = usable(vectors, id_col, vec_col).dropDuplicates(["id"]).select("id", "v", F.size("v").alias("size"), band.alias("band"))
    asked = usable(vectors if queries is None else queries, id_col, vec_col).dropDuplicates(["id"]).select("id", "v", F.size("v").alias("size"))
    parts = lambda n, most: F.ceil(n / most).cast("int")
    counts, _ = written(rows.groupBy("size", "band").agg(parts(F.count("*"), shard_rows).alias("shards")), "shards")
    blocks, _ = written(asked.groupBy("size").agg(parts(F.count("*"), block_rows).alias("blocks")), "blocks")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    key = ["size", "band", "shard", "block"]
    places = counts.join(blocks, "size")  # a row for each length and band
    entries = rows.join(places, ["size", "band"]).select("id", "v", "size", "band", own("shards", 1).alias("shard"), upto("blocks").alias("block"))
    visits = asked.select("id", "v", "size").join(places, "size").select("id", "v", "size", "band", own("blocks", 2).alias("block"), upto("shards").alias("shard"))

    def search(held: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        if held.empty or asked_.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "scored": [], "held": []})
        ids, x = held["id"].to_numpy(), np.array(held["v"].tolist())
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        norms = (x * x).sum(1)
        unit = math.sqrt(norms.max())
        forest = Forest(hash_strings(x / unit, np.sqrt(np.maximum(0.0, 1 - norms / unit**2)), trees, seed))
        q, who = np.array(asked_["v"].tolist()), asked_["id"].to_numpy()
        strings = hash_strings(q / np.sqrt((q * q).sum(1))[:, None], np.zeros(len(q)), trees, seed)
        enough, out = enough_of(len(ids), k), []
        for at in range(0, len(q), 256):
            for i, near in enumerate(forest.candidates(strings[at : at + 256], enough), at):
                near = near[ids[near] != who[i]]
                mine = x[near]
                rough = mine @ q[i]
                scored = len(near)
                if scored > k:  # what may be among the best, whatever the product's rounding
                    best = rough >= np.partition(rough, scored - k)[scored - k] - 1e-9 * unit * math.sqrt(q[i] @ q[i])
                    near, mine = near[best], mine[best]
                score = (mine * q[i]).sum(1)
                best = np.lexsort((ids[near], -score))[:k]
                out.append(pd.DataFrame({"query_id": who[i], "vec_id": ids[near[best]], "score": score[best], "scored": scored, "held": len(ids)}))
        return pd.concat(out)

    best = entries.groupBy(*key).cogroup(visits.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score double, scored long, held long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "scored", "held")
