"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Circulant MinHash (Li and Li, 2021) needs two permutations: sigma deals a set's elements over the
universe, pi orders it; coordinate k of the signature is the least pi((sigma(x) - k) mod D) of the set,
that is, pi circularly shifted by k. Here D = 2**32 and both are mixing bijections.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmill.llm.components import connected_components
from cohortmill.llm.pieces import forget
from cohortmill.llm.shingles import in_pieces, shingle_sets
from cohortmill.session import dropped, written

_M = np.uint32


def _pi(y: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 32-bit universe (murmur3's finaliser after a constant)."""
    y = y ^ _M(0x5BD1E995)
    y ^= y >> _M(16)
    y *= _M(0x85EBCA6B)
    y ^= y >> _M(13)
    y *= _M(0xC2B2AE35)
    y ^= y >> _M(16)
    return y


def circulant_signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """A row of k uint32 coordinates per set; sets must not be empty."""
    if not sets:
        return np.zeros((0, k), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    sigma = (np.concatenate(sets) * np.uint64(0xA24BAED4963EE407) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), k), np.uint32)
    for shift in range(k):
        out[:, shift] = np.minimum.reduceat(_pi(sigma - _M(shift)), at)
    return out


def _band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` coordinates; the band's number is part of the key."""
    n, k = sig.shape
    bands = sig.reshape(n, k // rows, rows).astype(np.uint64)
    key = np.arange(1, k // rows + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(rows):
        key = (key ^ bands[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """(doc, n, cls, keys): set size, 16-byte digest of the whole set, band keys; cls null if the set is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in batches:
            for a, b in in_pieces(pdf["t"].tolist()):
                part = pdf.iloc[a:b]
                sets = shingle_sets(part["t"].tolist(), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                for i, row in zip(full, _band_keys(circulant_signatures([sets[i] for i in full], bands * rows), rows), strict=True):
                    keys[i] = row
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pd.DataFrame({"doc": part["doc"].array, "n": np.array([len(s) for s in sets], np.int64), "cls": digest, "keys": keys})

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t")).mapInPandas(run, "doc long, n long, cls binary, keys array<long>")


def _class_sets(texts: DataFrame, width: int) -> DataFrame:
    """(cls, s, odd) of the texts, cls recomputed as the set's digest; odd is the parity of the elements in 512
    slots, which bounds from below how much two sets differ."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in in_pieces(pdf["t"].tolist()):
                sets = shingle_sets(pdf["t"].iloc[a:b].tolist(), width)
                odd = [np.packbits((np.bincount((x >> np.uint64(41) & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).view(np.int64) for x in sets]
                sets = [x.tobytes() for x in sets]
                yield pd.DataFrame({"cls": [hashlib.blake2b(x, digest_size=16).digest() for x in sets], "s": sets, "odd": odd})

    return texts.select("t").mapInPandas(run, "cls binary, s binary, odd array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * |A & B| >= percent * |A | B|."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["sa"], pdf["sb"], strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pdf.loc[keep, ["a", "b"]]

    left = sets.select(F.col("cls").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("s").alias("sb"))
    size = lambda c: F.length(c) / 8
    # sets of too different sizes can't reach the threshold, whatever they share
    near = (size("sa") * 100 >= size("sb") * percent) & (size("sb") * 100 >= size("sa") * percent)
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").where(near).select("a", "b", "sa", "sb").mapInPandas(run, "a binary, b binary")


def _elements(sets: DataFrame) -> DataFrame:
    """(token, cls): every element of the sets; arrays go out in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("s").to_pylist()
            size = np.array([len(x) // 8 for x in raw], np.int64)
            for a, b in in_pieces([range(k) for k in size], 200_000):
                token = np.frombuffer(b"".join(raw[a:b]), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token), batch.column("cls").take(pa.array(np.repeat(np.arange(a, b), size[a:b])))], ["token", "cls"])

    return sets.select("cls", "s").mapInArrow(run, "token long, cls binary")


#: Sizes of sets fall into classes whose bounds grow by this factor.
_STEP = 1.05


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(_STEP)).cast("int")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(band, token, role, cls, component, n, odd, at): where sets(cls, component, s, odd) must meet if two of them are similar.

    Prefix filtering with one global order of elements, rarest first. Sets x and y, y not the larger one, are
    similar only if they share at least percent / (100 + percent) * (|x| + |y|) elements, so the first shared one
    stands among the first |x| - that + 1 of x and |y| - that + 1 of y. y is indexed under its own class of sizes;
    x probes each class that may hold a partner, with the prefix that the least size of the class calls for.
    Elements that only one set has come first and meet nobody: a set of many such elements is in no bucket.
    """
    elements = _elements(sets)
    seen = elements.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    common = elements.join(seen.hint("merge"), "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("e"))
    common = common.join(sets.select("cls", "component", "odd", (F.length("s") / 8).cast("long").alias("n")).hint("merge"), "cls")
    n = F.col("n")
    shared = lambda m: F.ceil((n + m) * percent / (100 + percent) - 1e-6)  # noqa: E731  least number of shared elements
    least = F.ceil(n * percent / 100 - 1e-6)
    floor_of = lambda k: F.greatest(least, F.floor(F.pow(F.lit(_STEP), k) * (1 - 1e-9)))  # noqa: E731  least partner of class k
    own = n - F.size("e")  # so many elements are in no other set
    cut = lambda length: F.slice("e", 1, F.greatest(F.lit(0), length - own).cast("int"))
    row = lambda k, role: lambda e, i: F.struct(k.alias("band"), e["token"].alias("token"), F.lit(role).alias("role"), (own + i).alias("at"))
    index = F.transform(cut(n - shared(n) + 1), row(_size_class(n), "y"))
    probe = F.flatten(F.transform(F.sequence(_size_class(least), _size_class(n)), lambda k: F.transform(cut(n - shared(floor_of(k)) + 1), row(k, "x"))))
    return common.select("cls", "component", "n", "odd", F.explode(F.concat(index, probe)).alias("r")).select("r.band", "r.token", "r.role", "cls", "component", "n", "odd", "r.at")


def _rest(sets: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """(a, b): all pairs of sets(cls, component, s, odd) that may be similar and lie in two components.

    A bucket's members of its largest component meet the others alone, never each other; what sizes, places in
    the order and parities rule out is left in the bucket.
    """
    rows, path = written(_prefixes(sets, percent), "prefix")
    key = ["band", "token"]
    parts = rows.groupBy(*key, "component").agg(F.count("*").alias("c"), F.max(F.col("role") == "y").alias("held"))
    mixed = parts.groupBy(*key).agg(F.max(F.struct("c", "component")).alias("m"), F.count("*").alias("parts"), F.max("held").alias("held")).where("parts > 1 and held").select(*key, F.col("m.component").alias("main"))
    met, met_path = written(rows.join(mixed.hint("merge"), key).select(*key, "role", "cls", "component", "n", "odd", "at", (F.col("component") == F.col("main")).alias("main")), "met")
    side = lambda role: met.where(F.col("role") == role).select(*key, *[F.col(c).alias(f"{role}_{c}") for c in ("cls", "component", "n", "odd", "at", "main")])
    x, y = side("x"), side("y")
    shared = F.ceil((F.col("x_n") + F.col("y_n")) * percent / (100 + percent) - 1e-6)
    apart = sum((F.bit_count(F.col("x_odd")[k].bitwiseXOR(F.col("y_odd")[k])) for k in range(8)), F.lit(0))  # slots of odd difference, an element each
    similar = apart * (100 + percent) <= (F.col("x_n") + F.col("y_n")) * (100 - percent)
    fits = (F.col("x_n") >= F.col("y_n")) & (F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) >= shared) & (F.col("x_component") != F.col("y_component")) & similar
    pairs = x.where("not x_main").join(y.hint("merge"), key).where(fits).union(x.where("x_main").join(y.where("not y_main").hint("merge"), key).where(fits))
    return pairs.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b")).distinct(), [path, met_path]


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, bands: int = 16, rows: int = 4
) -> DataFrame:
    """Per row of docs: (id_col, n_shingles, component_id, kept).

    Sets are whole: distinct shingles of `width` words, the sequence itself for shorter texts, empty
    without words. Equal sets form a class, linked by equality; classes that share a band key are
    candidates; candidates are confirmed on their full sets. component_id is the smallest id that links
    reach; kept marks the row that carries it.

    Within a bucket of candidates all pairs are never made. One leader, the member whose own buckets hold the most
    rows (the middle of a group), is compared with every member and links are joined to components. Members of buckets that still hold several components meet by prefix
    filtering (_prefixes), which is exact: of the pairs of two components all that can reach the similarity are
    confirmed on their full sets, and components are those of all candidate pairs.

    Null ids take no part in links: component_id null, kept true. Null and empty texts: 0 shingles, the
    own component. Repeated rows (same id and text) share a component and are both marked kept; rows of
    one id with different texts are documents of their own. Columns of docs other than the two are not
    read, so clashing names do no harm. An empty table gives an empty result. Very long texts are read
    whole; a batch of them is cut into pieces, and a single text takes memory in proportion to its length.
    A link of similarity 0.85 is missed with probability (1 - 0.85**4)**16 < 1e-5.
    """
    spark = docs.sparkSession
    slim, slim_path = written(sketch(docs, id_col, text_col, width, bands, rows), "sketch")
    classes, classes_path = written(
        slim.where("cls is not null and doc is not null").groupBy("cls").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"), F.first("keys").alias("keys")), "classes"
    )
    member = classes.select("cls", "rep", F.explode("keys").alias("bucket"))
    buckets = member.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    held, held_path = written(member.join(buckets.hint("merge"), "bucket"), "held")
    weight = held.groupBy("cls").agg(F.sum("size").alias("weight"))
    lead = held.join(weight.hint("merge"), "cls").groupBy("bucket").agg(F.max(F.struct("weight", F.xxhash64("cls").alias("h"), "cls"))["cls"].alias("lead"))
    members, members_path = written(held.join(lead.hint("merge"), "bucket").select("bucket", "cls", "rep", "lead"), "members")
    dropped(spark, held_path)
    ids = members.select(F.col("rep").alias("doc")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("t")).join(ids.hint("shuffle_hash"), "doc")
    # the digest is taken again, as an id may stand on rows with different texts
    sets, sets_path = written(_class_sets(texts, width).dropDuplicates(["cls"]), "sets")
    led = members.where("cls <> lead")
    links, links_path = written(_verified(led.select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct(), sets, percent), "links")
    comp, comp_path = connected_components(links)
    waiting = led.select("bucket", "cls").join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = waiting.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("bucket")
    open_ = waiting.join(mixed.hint("merge"), "bucket").select("cls", "component").distinct()
    open_sets, open_path = written(sets.join(open_.hint("merge"), "cls"), "open")
    pairs, paths = _rest(open_sets, percent)
    more, more_path = written(_verified(pairs, sets, percent), "links")
    dropped(spark, comp_path, open_path, *paths)
    comp, comp_path = connected_components(links.union(more))
    roots = classes.select("cls", "rep", "copies").join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left").where("copies > 1 or component is not null")
    root = roots.select("cls", F.coalesce("component", "cls").alias("component"), "rep")
    least = root.groupBy("component").agg(F.min("rep").alias("root"))
    final, final_path = written(root.join(least.hint("merge"), "component").select("cls", "root"), "roots")
    dropped(spark, links_path, more_path, comp_path, sets_path, members_path, classes_path)
    out = slim.select("doc", "n", F.when(F.col("doc").isNotNull(), F.col("cls")).alias("cls")).join(final.hint("merge"), "cls", "left")
    root_id = F.coalesce("root", "doc")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), root_id.alias("component_id"), F.coalesce(root_id == F.col("doc"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each group: the rows whose id is the component's smallest, once each.

    Rows with a null id stay. Repeated rows of a kept id are few; only they are shuffled to be told apart.
    """
    marks = near_duplicates(docs, id_col, text_col, **how)
    spark = docs.sparkSession
    slim, _ = written(marks.where(F.col("kept") & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__kept_id")).agg(F.count("*").alias("__kept_rows"), F.countDistinct("n_shingles").alias("__n")), "kept")
    kept = docs.join(slim.select("__kept_id", "__kept_rows").hint("shuffle_hash"), F.col(id_col) == F.col("__kept_id"), "inner")
    rest = docs.where(F.col(id_col).isNull())
    once = kept.where("__kept_rows = 1").select(*docs.columns)
    again = kept.where("__kept_rows > 1").select(*docs.columns)
    if slim.where("__kept_rows > 1").isEmpty():
        return once.unionByName(rest)
    return once.unionByName(again.dropDuplicates([id_col, text_col])).unionByName(rest)
