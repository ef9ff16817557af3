"""Exact quantiles of groups of any size: small groups in order, large ones by counting in bins that narrow around the wanted ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cohortmill.session import written


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The equal bin of [lo, hi] that holds v: it never falls as v rises, so that ranks can be told from counts."""
    width = hi - lo
    return F.when(width > 0, F.least(F.lit(bins - 1), F.floor((v - lo) / width * bins))).otherwise(0).cast("int")


def exact_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], bins: int = 512, rounds: int = 2, few: int = 20_000, stored: bool = False) -> DataFrame:
    """(by, n, q): how many values a group has, and the quantiles qs of each as an array of doubles, between two ranks
    by linear interpolation. Null and NaN values don't count; a group without others is missing. A null group is one.
    value is a column of numbers, or of arrays of doubles; stored: df is a table already and needs no writing.

    The values of a group of up to `few` are put in order in one buffer, so that many small groups cost one exchange. Of a larger
    group, of which there is at most one in so many rows, none are: its values are counted.
    """
    many = isinstance(df.schema[value].dataType, ArrayType)
    if many:
        rows = df.select(*by, F.filter(value, lambda x: x.isNotNull() & ~F.isnan(x)).alias("v")).where(F.size("v") > 0)
    else:
        rows = df.select(*by, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    if not stored:
        rows, _ = written(rows, "values")
    n = F.sum(F.size("v")) if many else F.count("*")
    sizes, _ = written(rows.groupBy(*by).agg(n.cast("long").alias("n")), "sizes")
    large, _ = written(sizes.where(F.col("n") > few).select(*[F.col(c).alias(f"__{c}") for c in by]), "large")
    none = large.isEmpty()
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    small = rows if none else rows.join(large.hint("broadcast"), same, "left_anti")
    listed = F.flatten(F.collect_list("v")) if many else F.collect_list("v")
    small = small.groupBy(*by).agg(F.sort_array(listed).alias("s")).withColumn("n", F.size("s").cast("long"))
    out = small.select(*by, "n", F.array(*[_between("s", q) for q in qs]).alias("q"))
    if none:
        return out
    rest = rows.join(large.hint("broadcast"), same, "left_semi")
    rest = rest.select(*by, F.explode("v").alias("v")) if many else rest
    return out.unionByName(_counted(rest, by, qs, bins, rounds))


def _between(values: str, q: float) -> Column:
    """The quantile q of an array in order, or of a map by rank, of n values."""
    p = (F.col("n") - 1) * F.lit(float(q))
    k = F.floor(p)
    low, high = F.col(values)[k.cast("int")], F.col(values)[F.least(k + 1, F.col("n") - 1).cast("int")]
    return low + (high - low) * (p - k)


def _counted(df: DataFrame, by: list[str], qs: list[float], bins: int, rounds: int) -> DataFrame:
    """exact_quantiles() of (by, v) with few and large groups.

    A round counts the values of a range in equal bins by hash aggregation and narrows the range to the bin that holds
    the rank, down to the least and greatest value there; after `rounds` of them the values of the last bin alone are
    counted one by one and put in order. No group's values meet in one buffer: what is ordered is about a
    bins**rounds-th of them, or the different values that a very uneven group leaves in a bin, which spills as any sort.
    """
    rows, _ = written(df, "values")
    range_ = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p).cast("long"), F.least(F.floor(p).cast("long") + 1, F.col("n") - 1)) for p in [(F.col("n") - 1) * F.lit(float(q)) for q in qs]])))
    # wanted: per group and rank, the range of values that holds it, and how many values stand before the range
    wanted, _ = written(range_.select(*by, "n", "lo", "hi", F.lit(0).cast("long").alias("before"), F.explode(ranks).alias("rank")), "ranks")
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]

    def held(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """Values in the ranges, a row for each range; ranges of a group are apart or equal."""
        ranges = wanted.select(*by, "lo", "hi", "before").distinct()
        ranges = ranges.groupBy(*by).agg(F.collect_set(F.struct("lo", "hi", "before")).alias("r"))
        both = rows.alias("a").join(ranges.alias("b"), same("a", "b"))
        return both.select(*[F.col(f"a.{c}") for c in by], "v", F.explode(F.filter("r", lambda x: F.col("v").between(x["lo"], x["hi"]))).alias("x")).select(*by, "v", "x.lo", "x.hi", "x.before")

    for _ in range(rounds):
        found = held(rows, wanted).groupBy(*by, "lo", "hi", "before", _bin(F.col("v"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo1"), F.max("v").alias("hi1"))
        w = Window.partitionBy(*by, "lo", "hi").orderBy("bin")
        found = found.withColumn("b1", F.col("before") + F.sum("c").over(w) - F.col("c"))
        at = wanted.alias("a").join(found.alias("b"), [*same("a", "b"), F.col("a.lo") == F.col("b.lo"), F.col("a.hi") == F.col("b.hi"), F.col("rank") >= F.col("b1"), F.col("rank") < F.col("b1") + F.col("c")])
        wanted, _ = written(at.select(*[F.col(f"a.{c}") for c in by], "n", F.col("lo1").alias("lo"), F.col("hi1").alias("hi"), F.col("b1").alias("before"), "rank"), "ranks")
    each = held(rows, wanted).groupBy(*by, "lo", "hi", "before", "v").agg(F.count("*").alias("c"))
    each = each.withColumn("b1", F.col("before") + F.sum("c").over(Window.partitionBy(*by, "lo", "hi").orderBy("v")) - F.col("c"))
    at = wanted.alias("a").join(each.alias("b"), [*same("a", "b"), F.col("a.lo") == F.col("b.lo"), F.col("a.hi") == F.col("b.hi"), F.col("rank") >= F.col("b1"), F.col("rank") < F.col("b1") + F.col("c")])
    known = at.select(*[F.col(f"a.{c}") for c in by], "n", "rank", "v").groupBy(*by, "n").agg(F.map_from_entries(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "v"))).alias("m"))
    return known.select(*by, "n", F.array(*[_between("m", q) for q in qs]).alias("q"))


def joined(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """df with __q, the quantiles of its group, null where the group has no values."""
    q = exact_quantiles(df, by, value, qs)
    names = [f"__by{k}" for k in range(len(by))]
    q = q.select(*[F.col(c).alias(a) for c, a in zip(by, names, strict=True)], F.col("q").alias("__q"))
    on = [F.col(c).eqNullSafe(F.col(a)) for c, a in zip(by, names, strict=True)]
    return df.join(q, on, "left").drop(*names)
