"""Parameter designs: sampling, splitting, subsets, audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortmill.operators.quantiles import exact_quantiles
from cohortmill.session import dropped, written


def _feistel(index: Column, bits: int, keys: list[int]) -> Column:
    """A keyed permutation of [0, 2**(2 * bits)): four rounds over two halves, no shuffle."""
    mask = (1 << bits) - 1
    left, right = F.shiftright(index, bits).bitwiseAND(F.lit(mask)), index.bitwiseAND(F.lit(mask))
    for k in keys:
        left, right = right, left.bitwiseXOR(F.pmod(F.xxhash64(F.lit(k), right), F.lit(1 << bits)))
    return F.shiftleft(left, bits) + right


def permuted(index: Column, n: int, seed: int, dim: int, walks: int = 24) -> Column:
    """A permutation of [0, n) by cycle walking: the keyed permutation of the next power of four is applied until it
    lands under n. Under a quarter of the domain is at least used, so walks end early; the bound is for the expression."""
    bits = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    keys = [seed * 1000003 + dim * 101 + r for r in range(4)]
    step = lambda x: _feistel(x, bits, keys)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(4 * walks)), step(index.cast("long")), lambda x, _: F.when(x < n, x).otherwise(step(x)))
    return walk


def lhs_design(spark: SparkSession, n: int, bounds: dict[str, tuple[float, float]], seed: int = 0) -> DataFrame:
    """(idx, params): a Latin hypercube. Each parameter has one point in each of n equal strata, strata are permuted
    independently by keyed permutations, and the place in a stratum is a hash. Same seed, same design, on any
    cluster; no sort and no shuffle."""
    cols = []
    for d, (name, (lo, hi)) in enumerate(bounds.items()):
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(d), F.col("id")), 11) / F.lit(float(1 << 53))
        cols.append((F.lit(lo) + (permuted(F.col("id"), n, seed, d) + u) / float(n) * (hi - lo)).alias(name))
    return spark.range(n).select(F.col("id").alias("idx"), *cols)


def normalize_params(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Parameters scaled to [0, 1] by their bounds; a bound without width gives 0."""
    return df.withColumns({c: ((F.col(c) - lo) / (hi - lo) if hi > lo else F.lit(0.0)) for c, (lo, hi) in bounds.items()})


def maximin_subset(points: DataFrame, k: int, id_col: str, vec_col: str, candidates: int = 512) -> DataFrame:
    """(id, pick): greedy farthest points. It starts with the lowest id; each pick is the point whose least distance to
    those taken is largest, the lowest id on a tie. With k at least the number of points all are taken.

    A pass over the vectors finds the `candidates` points farthest from all that are taken. Distances only fall with further
    picks, so that the best candidate is the next pick for sure as long as it is farther than the last candidate was: many
    picks come of one pass. Vectors are written once and only read; what reaches the driver is the picks and a pass's candidates.
    """
    spark = points.sparkSession
    v, path = written(points.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null"), "points")
    start = v.orderBy("id").limit(1).collect()
    picked, taken = [r["id"] for r in start], [np.array(r["v"]) for r in start]

    def farthest(taken: np.ndarray, picked: list):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[~pdf["id"].isin(picked)]
                if len(pdf):
                    x = np.array(pdf["v"].tolist())
                    d = np.full(len(x), np.inf)
                    for p in taken:
                        d = np.minimum(d, ((x - p) ** 2).sum(1))
                    yield pdf.assign(d=d).sort_values(["d", "id"], ascending=[False, True]).head(candidates)

        return run

    while picked and len(picked) < k:
        kind = ", ".join(f"{c} {t}" for c, t in v.dtypes) + ", d double"
        best = v.mapInPandas(farthest(np.array(taken), list(picked)), kind).orderBy(F.desc("d"), "id").limit(candidates).collect()
        if not best:
            break
        ids, x, d = [r["id"] for r in best], np.array([r["v"] for r in best]), np.array([r["d"] for r in best])
        bound = (-d[-1], ids[-1]) if len(best) == candidates else None
        left = set(range(len(best)))
        while left and len(picked) < k:
            i = min(left, key=lambda j: (-d[j], ids[j]))
            if bound is not None and (-d[i], ids[i]) > bound:
                break
            left.remove(i)
            picked.append(ids[i])
            taken.append(x[i])
            d = np.minimum(d, ((x - x[i]) ** 2).sum(1))
    dropped(spark, path)
    if not picked:
        return v.select("id", F.lit(0).alias("pick")).where("false")
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in picked])).alias("pick", "id")).select("id", "pick")


def assign_fidelity(points: DataFrame, chosen: DataFrame, id_col: str, n_lf: int, n_hf: int, paired: bool = False) -> DataFrame:
    """points with fidelity HF for the chosen, LF for the others, and the mesh variant; paired gives chosen points a row of each."""
    if n_hf > n_lf:
        raise ValueError("more high-fidelity than low-fidelity points")
    mark = chosen.select(F.col("id").alias(id_col), F.lit(True).alias("__hf"))
    kinds = F.when(F.col("__hf"), F.array(F.lit("HF"), F.lit("LF")) if paired else F.array(F.lit("HF"))).otherwise(F.array(F.lit("LF")))
    rows = points.join(mark, id_col, "left").withColumn("fidelity", F.explode(kinds)).drop("__hf")
    return rows.withColumn("mesh", F.when(F.col("fidelity") == "HF", "fine").otherwise("coarse"))


def doe_summary(results: DataFrame, ok: Column, required: int = 500) -> DataFrame:
    """One row: n_total, n_success, n_failed, success_rate in percent to one digit, and slo_passed."""
    s = results.agg(F.count("*").alias("n_total"), F.count_if(ok).alias("n_success"))
    return s.select("n_total", "n_success", (F.col("n_total") - F.col("n_success")).alias("n_failed"), F.round(F.when(F.col("n_total") > 0, 100.0 * F.col("n_success") / F.col("n_total")).otherwise(0.0), 1).alias("success_rate"), (F.col("n_success") >= required).alias("slo_passed"))


def output_variance_audit(results: DataFrame, outputs: list[str], least: float = 0.01) -> DataFrame:
    """(output, std, constant): population deviation of each output in one pass; constant where it is at most `least`."""
    one = results.agg(*[F.stddev_pop(c).alias(c) for c in outputs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("output"), F.col(c).alias("std"), (F.col(c) <= least).alias("constant")) for c in outputs])))


def run_cost_profile(runs: DataFrame, param: str, low: float, high: float, bands: int, cost: str) -> DataFrame:
    """(band, n, mean, p50, p90, total) of a cost by equal bands of a parameter; 0 and bands + 1 are outside."""
    band = F.width_bucket(F.col(param), F.lit(low), F.lit(high), F.lit(bands))
    rows, _ = written(runs.select(band.alias("band"), F.col(cost).alias("c")), "costs")
    q = exact_quantiles(rows, ["band"], "c", [0.5, 0.9]).select(F.col("band").alias("__band"), F.col("q")[0].alias("p50"), F.col("q")[1].alias("p90"))
    out = rows.groupBy("band").agg(F.count("*").alias("n"), F.avg("c").alias("mean"), F.sum("c").alias("total"))
    return out.join(q, F.col("band").eqNullSafe(F.col("__band")), "left").select("band", "n", "mean", "p50", "p90", "total")


def first_frame(rows: DataFrame, by: str, order: str, n: int | None = None) -> DataFrame:
    """The lowest frame of each group, of the first n groups if n is given."""
    first = rows.groupBy(by).agg(F.min(order).alias(order))
    return first if n is None else first.orderBy(by).limit(n)


def train_val_split(rows: DataFrame, key: str, share: float = 0.8, seed: str = "42") -> DataFrame:
    """rows with split: exactly the floor of the share goes to train, by rank of a keyed hash.

    Ranks don't need one sorted partition: hashes fall into 4,096 buckets, counts before a bucket and the rank
    within it add up; a bucket holds about a 4,096th of the rows whatever the keys.
    """
    h = F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")), 256)
    x = rows.withColumns({"__h": h, "__b": F.conv(F.substring(h, 1, 3), 16, 10).cast("int")})
    n = x.groupBy("__b").agg(F.count("*").alias("__n")).coalesce(1)
    before = n.withColumn("__before", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy(F.lit(1))))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) + F.col("__before")
    return x.join(F.broadcast(before.drop("__n")), "__b").withColumn("split", F.when(rank <= F.floor(F.col("__all") * F.lit(share)), "train").otherwise("val")).drop("__h", "__b", "__before", "__all")


def _keyed(seed: int, c: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), (F.col(c) if isinstance(c, str) else c).cast("string")), 256)


def sample_with_replacement(rows: DataFrame, draws: int, key: str, seed: int = 0) -> DataFrame:
    """(draw, key): `draws` rows with repeats. A row's place is its rank by a keyed hash, counted in 4,096 buckets of the
    hash and before them, so that no sort is of all rows; a draw's place is a hash of its number. Null keys are not drawn;
    no row, no draw. How many rows there are is joined as a table of one row, not asked for."""
    by = rows.where(F.col(key).isNotNull()).withColumn("__h", _keyed(seed, key)).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    sizes = by.groupBy("__b").agg(F.count("*").alias("__n")).coalesce(1)
    sizes = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__b")) - F.col("__n"))  # 4,096 rows
    place = by.join(F.broadcast(sizes.select("__b", "__before")), "__b").select(key, (F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1 + F.col("__before")).alias("__place"))
    number = F.conv(F.substring(_keyed(seed + 1, "id"), 1, 12), 16, 10).cast("long")
    d = rows.sparkSession.range(draws).join(F.broadcast(by.agg(F.nullif(F.count("*"), F.lit(0)).alias("__all"))), how="cross").select(F.col("id").alias("draw"), (number % F.col("__all")).alias("__place"))
    return d.join(place.hint("merge"), "__place").select("draw", key)


def oversample_foreground(rows: DataFrame, rare: Column, draws: int, key: str, share: float = 0.66) -> DataFrame:
    """(draw, key, forced): at least the share of draws, rounded up, from rows that hold a rare label, the rest from all."""
    forced = -int(-draws * share // 1)
    a = sample_with_replacement(rows.where(rare), forced, key, 1).withColumn("forced", F.lit(True))
    b = sample_with_replacement(rows, draws - forced, key, 2).select((F.col("draw") + forced).alias("draw"), key, F.lit(False).alias("forced"))
    return a.unionByName(b)
