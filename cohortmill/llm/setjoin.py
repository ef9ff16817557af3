"""Jaccard join of word n-grams by token-combination prefixes.

Elements of the sets (tokens) stand in one order for all sets, rarest first. Two similar sets share all but a few of
their first tokens; if the prefix is extended, they share several of them, so that combinations of k tokens can be
indexed where single ones are frequent. Frequent tokens are dealt into classes; in a class of k-token combinations
a set may lose c - k + 1 of c tokens before its last combination is gone, and a prefix reaches so far that its
classes together stand more losses than a partner can cause. Rare tokens are classes of their own, of one token.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.components import connected_components
from cohortmill.llm.minhash import _class_sets, _elements, _verified
from cohortmill.llm.shingles import in_pieces, mix64, shingle_sets
from cohortmill.session import dropped, importable, written

#: Tokens of more than so many sets are indexed by pairs and by triples.
PAIRS_FROM, TRIPLES_FROM = 32, 1024


def least_overlap(n: int, percent: int) -> int:
    """How many elements a set of n shares at least with any set as large or larger that is similar."""
    return -(-n * percent // 100)


def _heads(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(doc, n, cls, head, enough): set size, digest of the set, and the least hashes of it, in number half more than a
    similar set can lack, plus one; `enough` of them are in another set if one is similar. cls null if the set is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in in_pieces(pdf["t"].tolist()):
                part = pdf.iloc[a:b]
                sets = shingle_sets(part["t"].tolist(), width)
                lack = [len(s) - least_overlap(len(s), percent) for s in sets]
                enough = [1 + x // 2 for x in lack]
                head = [s[: x + e].tobytes() if len(s) else None for s, x, e in zip(sets, lack, enough, strict=True)]
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pd.DataFrame({"doc": part["doc"].array, "n": np.array([len(s) for s in sets], np.int64), "cls": digest, "head": head, "enough": np.array(enough, np.int64)})

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t")).mapInPandas(run, "doc long, n long, cls binary, head binary, enough long")


@lru_cache(maxsize=4096)
def _choices(c: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(c), k)), np.int64).reshape(-1, k)


def _levels(n: int, percent: int) -> list[int]:
    """The level of a set's own size, and the next one if a larger similar set can be there: the larger one's level counts."""
    own = n.bit_length() - 1
    return [own, own + 1] if n * 100 // percent >= 2 << own else [own]


def _classes(level: int, percent: int) -> int:
    """Into how many classes frequent tokens are dealt at a level; 0: single tokens only, as sets are too small to lose any.
    A set of the level holds t * 2**level elements at least (t for percent / 100), of which a partner has all but a
    share of 1 - t: three a class, what classes of pairs and of triples can lose at most, must be left of the rest."""
    t = percent / 100
    room = int((t * t * 2**level - 1) / 3)
    return min(room, max(1, int(0.9 * (1 - t) * 2**level)))


def combination_keys(df: np.ndarray, token: np.ndarray, n: int, percent: int, pairs_from: int = PAIRS_FROM, triples_from: int = TRIPLES_FROM) -> np.ndarray:
    """Keys of a set of n elements, of which `token`, rarest first, in df sets each, are in other sets too (the n -
    len(token) others come before them in the order). Two similar sets have a key in common."""
    keys = []
    for level in _levels(n, percent):
        lack = n - least_overlap(max(n, 1 << level), percent)
        need = lack + 1 - (n - len(token))  # losses that the prefix must stand; tokens of one set alone stand one each
        if need <= 0:
            continue
        classes = _classes(level, percent)
        k = np.ones(len(df), np.int64) if not classes else 1 + (df > pairs_from) + (df > triples_from)
        mixed = mix64(token ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF))
        cls = np.where(k == 1, np.arange(len(df)) + 2 * max(classes, 1), (mixed % np.uint64(max(classes, 1))).astype(np.int64) + (k == 3) * classes)
        order = np.argsort(cls, kind="stable")
        first = np.flatnonzero(np.diff(cls[order], prepend=-1))
        nth = np.empty(len(df), np.int64)
        nth[order] = np.arange(len(df)) - np.repeat(first, np.diff(first, append=len(df)))
        stands = np.cumsum(nth >= k - 1)
        if stands[-1] < need:
            raise AssertionError("a prefix can't be longer than its set")
        cut = int(np.searchsorted(stands, need)) + 1
        keys.append(mixed[:cut][k[:cut] == 1])
        held = order[(order < cut) & (k[order] > 1)]
        for group in np.split(held, np.flatnonzero(np.diff(cls[held])) + 1) if len(held) else ():
            if len(group) >= k[group[0]]:
                pick = mixed[group][_choices(len(group), int(k[group[0]]))]
                keys.append(mix64(pick.sum(axis=1, dtype=np.uint64) + np.uint64(pick.shape[1])))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def _buckets(sets: DataFrame, percent: int, pairs_from: int, triples_from: int) -> DataFrame:
    """(bucket, cls): the keys of sets(cls, s, odd), by exact counts of their elements."""
    elements = _elements(sets)
    seen = elements.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    common = elements.join(seen.hint("merge"), "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("e"))
    common = common.join(sets.select("cls", (F.length("s") / 8).cast("long").alias("n")).hint("merge"), "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            df, token = batch.column("df"), batch.column("token")
            at, df, token = df.offsets.to_numpy() - df.offsets[0].as_py(), df.flatten().to_numpy(), token.flatten().to_numpy().view(np.uint64)
            keys = [combination_keys(df[a:b], token[a:b], n, percent, pairs_from, triples_from) for a, b, n in zip(at, at[1:], batch.column("n").to_pylist(), strict=False)]
            back = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
            bucket = np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)
            for a in range(0, len(bucket), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[a : a + 200_000]), batch.column("cls").take(pa.array(back[a : a + 200_000]))], ["bucket", "cls"])

    rows = common.select("cls", "n", F.transform("e", lambda x: x["df"]).alias("df"), F.transform("e", lambda x: x["token"]).alias("token"))
    return rows.mapInArrow(run, "bucket long, cls binary")


def _apart(x: str, y: str):
    """Slots of odd difference between two sets' parities: so many elements at least are in one of them alone."""
    return sum((F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(8)), F.lit(0))


def _rest(members: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """(a, b): pairs of members(bucket, cls) of one bucket and two components that sizes and parities allow to be similar.
    Members of a bucket's largest component meet the others alone, never each other."""
    at = members.select("bucket", "cls").join(comp.select(F.col("node").alias("cls"), "component").hint("merge"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    at, at_path = written(at, "at")
    parts = at.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1").select("bucket", F.col("m.component").alias("main"))
    open_, open_path = written(at.join(mixed.hint("merge"), "bucket").select("bucket", "cls", "component", (F.col("component") == F.col("main")).alias("main")), "open")
    slim = sets.select("cls", (F.length("s") / 8).cast("long").alias("n"), "odd")
    met, met_path = written(open_.join(slim.hint("merge"), "cls"), "met")
    side = lambda s: met.select("bucket", *[F.col(c).alias(f"{s}_{c}") for c in ("cls", "component", "main", "n", "odd")])
    x, y = side("x"), side("y")
    sized = F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent
    similar = _apart("x_odd", "y_odd") * (100 + percent) <= (F.col("x_n") + F.col("y_n")) * (100 - percent)
    once = F.col("y_main") | (F.col("x_cls") < F.col("y_cls"))
    pairs = x.where("not x_main").join(y.hint("merge"), "bucket").where((F.col("x_component") != F.col("y_component")) & once & sized & similar)
    return pairs.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct(), [at_path, open_path, met_path]


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90, pairs_from: int = PAIRS_FROM, triples_from: int = TRIPLES_FROM
) -> DataFrame:
    """Per row of docs: (id_col, n_shingles, component_id).

    A document's set is its distinct shingles of `width` words (A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`), the whole
    sequence for shorter texts, empty without words. Documents are linked if 100 * |A & B| >= percent * |A | B|, an exact join:
    equal sets are one class; classes of which too few of the first hashes are in any other class have no partner; of
    the rest those that share a key (combination_keys) are candidates, confirmed on full sets. component_id is the smallest
    id that links reach.

    In a bucket all pairs are never made: one leader, the member whose buckets hold the most, meets every member;
    then only members of two components meet, but for two of the bucket's largest one. No link between components is lost.

    Null ids take no part in links: component_id null. Null and empty texts: 0 shingles, the own component. Repeated rows
    share a component; rows of one id with different texts are documents of their own. Columns other than the two are
    not read, so clashing names do no harm. An empty table gives an empty result. Long texts are read whole; memory goes
    with the longest one. percent is from 50 to 100. pairs_from and triples_from set the work, not the result.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = docs.sparkSession
    importable(spark)
    slim, slim_path = written(_heads(docs, id_col, text_col, width, percent), "heads")
    classes, classes_path = written(slim.where("cls is not null and doc is not null").groupBy("cls").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("head").alias("s"), F.first("enough").alias("enough")), "classes")
    first, first_path = written(_elements(classes), "first")
    seen = first.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    live = first.join(seen.hint("merge"), "token").groupBy("cls").agg(F.count("*").alias("shared"))
    live, live_path = written(classes.select("cls", "rep", "enough").join(live.hint("merge"), "cls").where("shared >= enough").select("cls", "rep"), "live")
    dropped(spark, first_path)
    ids = live.select(F.col("rep").alias("doc")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t")).join(ids.hint("merge"), "doc")
    # the digest is taken again, as an id may stand on rows with different texts
    sets, sets_path = written(_class_sets(texts, width).dropDuplicates(["cls"]).join(live.select("cls").hint("merge"), "cls"), "sets")
    rows, rows_path = written(_buckets(sets, percent, pairs_from, triples_from), "buckets")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    held, held_path = written(rows.join(sizes.hint("merge"), "bucket"), "held")
    weight = held.groupBy("cls").agg(F.sum("size").alias("weight"))
    lead = held.join(weight.hint("merge"), "cls").groupBy("bucket").agg(F.max(F.struct("weight", "cls"))["cls"].alias("lead"))
    led = held.join(lead.hint("merge"), "bucket").where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    links, links_path = written(_verified(led, sets, percent), "links")
    comp, comp_path = connected_components(links)
    pairs, paths = _rest(held, comp, sets, percent)
    more, more_path = written(_verified(pairs, sets, percent), "links")
    dropped(spark, comp_path, rows_path, held_path, *paths)
    comp, comp_path = connected_components(links.union(more))
    root = classes.select("cls", "rep", "copies").join(comp.select(F.col("node").alias("cls"), "component").hint("merge"), "cls", "left").where("copies > 1 or component is not null")
    root = root.select("cls", F.coalesce("component", "cls").alias("component"), "rep")
    least = root.groupBy("component").agg(F.min("rep").alias("root"))
    final, _ = written(root.join(least.hint("merge"), "component").select("cls", "root"), "roots")
    dropped(spark, links_path, more_path, comp_path, sets_path, live_path, classes_path)
    out = slim.select("doc", "n", F.when(F.col("doc").isNotNull(), F.col("cls")).alias("cls")).join(final.hint("merge"), "cls", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))
