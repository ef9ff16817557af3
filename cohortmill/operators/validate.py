"""Projections, range checks and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Bounds = dict[str, tuple[float, float]]


def violations(bounds: Bounds) -> Column:
    """Names of the columns outside their closed range; null counts as outside."""
    bad = [F.when(~F.coalesce(F.col(c).between(lo, hi), F.lit(False)), F.lit(c)) for c, (lo, hi) in bounds.items()]
    return F.array_compact(F.array(*bad))


def validate_ranges(df: DataFrame, bounds: Bounds) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reasons)."""
    marked = df.withColumn("reasons", violations(bounds))
    return marked.where(F.size("reasons") == 0).drop("reasons"), marked.where(F.size("reasons") > 0)


def bounds_audit(df: DataFrame, bounds: Bounds) -> DataFrame:
    """(column, n_outside, n): one pass over df."""
    outside = [F.count_if(~F.coalesce(F.col(c).between(lo, hi), F.lit(False))).alias(c) for c, (lo, hi) in bounds.items()]
    one = df.agg(*outside, F.count("*").alias("__n"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_outside"), F.col("__n").alias("n")) for c in bounds])))


def remap(label: Column, mapping: dict[int, int]) -> Column:
    """A label by a short map; labels not in it become 0."""
    out = F.lit(0)
    for old, new in mapping.items():
        out = F.when(label == old, F.lit(new)).otherwise(out)
    return out


def in_micrometres(points: DataFrame, by: str, cols: tuple[str, ...] = ("x", "y", "z"), limit: float = 100.0) -> DataFrame:
    """points with coordinates times 1000 for groups in millimetres: those whose largest x is at most limit."""
    top = points.groupBy(by).agg(F.max(cols[0]).alias("__top"))
    factor = F.when(F.col("__top") > limit, 1.0).otherwise(1000.0)
    return points.join(top, by).withColumns({c: F.col(c) * factor for c in cols}).drop("__top")


def select_fields(df: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """Known fields only, 0.0 where null or absent."""
    return df.select(*keys, *[F.coalesce(F.col(f).cast("double") if f in df.columns else F.lit(None), F.lit(0.0)).alias(f) for f in fields])


def completed_only(df: DataFrame, state: Column, done: str, result: Column) -> DataFrame:
    """Results of completed rows, an error naming the state for the others."""
    ok = F.coalesce(state == done, F.lit(False))
    return df.withColumns({"result": F.when(ok, result), "error": F.when(~ok, F.concat(F.lit("not completed: "), F.coalesce(state, F.lit("unknown"))))})


def conductivity_multiplier(sigma: Column, reference: float = 0.30) -> Column:
    return sigma / reference


def status_band(value: Column, low: float, high: float) -> Column:
    """ok inside the closed band, warn outside, null for null."""
    return F.when(value.between(low, high), "ok").when(value.isNotNull(), "warn")


def missing_ground_truth(cases: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """cases whose key is not among truth's; a null key is missing."""
    return cases.join(truth.select(key), key, "left_anti")


def error_split(results: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(results that carry no error, those that do): means of a report are of the first, counts of both. An empty message is an error too."""
    return results.where(F.col(error).isNull()).drop(error), results.where(F.col(error).isNotNull())
