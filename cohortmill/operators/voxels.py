"""Voxel tables in long form: (case_id, z, y, x, intensity, label ..)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.operators.quantiles import joined

AXES = ("z", "y", "x")


def label_volumes(vox: DataFrame, label: str, labels: list[int], spacing: Column, case: str = "case_id") -> DataFrame:
    """(case, vol_<l> ..) in mL: voxel counts times the voxel's mm3 over 1000."""
    return vox.groupBy(case).agg(*[(F.count_if(F.col(label) == v) * F.first(spacing) / 1000.0).alias(f"vol_{v}") for v in labels])


def scar_burden(scar: Column, tissue: Column) -> Column:
    """Scar as a percentage of scar and tissue, 0 if there is neither."""
    return F.when(scar + tissue > 0, 100.0 * scar / (scar + tissue)).otherwise(0.0)


def label_histogram(vox: DataFrame, label: str, case: str = "case_id") -> DataFrame:
    """(case, label, n, pct); the window runs over counts, not voxels."""
    n = vox.groupBy(case, label).agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(case)))


def pair_labels(pred: DataFrame, truth: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, z, y, x, pred, truth) on the common grid."""
    return pred.join(truth, [case, *AXES])


POLICIES = {"empty_is_one": (0.0, 0.0), "smooth_both": (1e-5, 1e-5), "smooth_denominator": (0.0, 1e-5)}


def dice(pairs: DataFrame, labels: list[int], policy: str = "empty_is_one", pred: str = "pred", truth: str = "truth", case: str = "case_id") -> DataFrame:
    """(case, label, dice) in one pass. empty_is_one: 1 where neither has the label; the others add 1e-5 to both
    parts of the fraction or to its denominator."""
    top, bottom = POLICIES[policy]
    counts = pairs.groupBy(case).agg(
        *[F.count_if((F.col(pred) == v) & (F.col(truth) == v)).alias(f"__i{v}") for v in labels],
        *[(F.count_if(F.col(pred) == v) + F.count_if(F.col(truth) == v)).alias(f"__s{v}") for v in labels],
    )
    def value(v: int) -> Column:
        d = (2.0 * F.col(f"__i{v}") + top) / (F.col(f"__s{v}") + bottom)
        return F.when(F.col(f"__s{v}") == 0, 1.0).otherwise(d) if policy == "empty_is_one" else d
    return counts.select(case, F.inline(F.array(*[F.struct(F.lit(v).alias("label"), value(v).alias("dice")) for v in labels])))


# The least mean Dice of a label that passes, labels 1 RV, 2 MYO, 3 LV.
DICE_SLO = {1: 0.85, 2: 0.90, 3: 0.90}


def dice_report(scores: DataFrame, limits: dict[int, float] = DICE_SLO) -> DataFrame:
    """(label, mean_dice, n_cases, n_pass, slo) over cases without error."""
    limit = F.lit(None).cast("double")
    for v, x in limits.items():
        limit = F.when(F.col("label") == v, x).otherwise(limit)
    rows = scores.withColumn("__limit", limit)
    out = rows.groupBy("label").agg(F.avg("dice").alias("mean_dice"), F.count("*").alias("n_cases"), F.count_if(F.col("dice") >= F.col("__limit")).alias("n_pass"), F.first("__limit").alias("__l"))
    return out.withColumn("slo", F.col("mean_dice") >= F.col("__l")).drop("__l")


def annotated_frames(vox: DataFrame, label: str, least: int = 100, frame: str = "case_id") -> DataFrame:
    """Voxels of the frames with more than `least` labelled voxels."""
    rich = vox.groupBy(frame).agg(F.count_if(F.col(label) > 0).alias("__n")).where(F.col("__n") > least)
    return vox.join(rich.select(frame), frame, "left_semi")


def resample_nearest(ref: DataFrame, label: DataFrame, ratio: dict[str, float], value: str, case: str = "case_id") -> DataFrame:
    """ref's grid with the nearest label of a grid of another spacing; ratio is reference over label spacing, outside is 0."""
    look = ref.withColumns({f"__{a}": F.floor(F.col(a) * F.lit(float(ratio[a])) + 0.5).cast("int") for a in AXES})
    src = label.select(F.col(case).alias("__c"), *[F.col(a).alias(f"__{a}") for a in AXES], F.col(value).alias("__v"))
    j = look.join(src.withColumnRenamed("__c", case), [case, *[f"__{a}" for a in AXES]], "left")
    return j.withColumn(value, F.coalesce("__v", F.lit(0))).drop("__v", *[f"__{a}" for a in AXES])


def crop_or_pad(vox: DataFrame, target: dict[str, int], size: dict[str, int], offset: dict[str, Column] | None = None) -> DataFrame:
    """Voxels on the target grid. An axis longer than the target is cropped at its offset (middle by default); a
    shorter one is padded on both sides. Only voxels that exist are rows: what is absent is 0, as in any long grid."""
    out = vox
    for a in AXES:
        if size[a] >= target[a]:
            at = (offset or {}).get(a, F.lit((size[a] - target[a]) // 2))
            out = out.withColumn(a, F.col(a) - at).where(F.col(a).between(0, target[a] - 1))
        else:
            out = out.withColumn(a, F.col(a) + (target[a] - size[a]) // 2)
    return out


def dense(vox: DataFrame, target: dict[str, int], values: list[str], case: str = "case_id") -> DataFrame:
    """Every voxel of the target grid for each case, 0 where vox has none: the grid comes from sequences, by case."""
    grid = vox.select(case).distinct()
    for a in AXES:
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(target[a] - 1))))
    return grid.join(vox.select(case, *AXES, *values), [case, *AXES], "left").fillna(0, values)


def flip(vox: DataFrame, size: dict[str, int], bits: dict[str, Column]) -> DataFrame:
    """Axes mirrored where their bit holds; image and label share it, as they share the row."""
    return vox.withColumns({a: F.when(bits[a], size[a] - 1 - F.col(a)).otherwise(F.col(a)) for a in AXES})


def flip_bits(seed: int, case: str = "case_id") -> dict[str, Column]:
    return {a: F.pmod(F.xxhash64(F.lit(seed), F.lit(a), F.col(case)), F.lit(2)) == 0 for a in AXES}


def zscore(df: DataFrame, value: str, by: str, clip: tuple[float, float] | None = (0.5, 99.5), least: float = 1e-8) -> DataFrame:
    """df with z: clipped to percentiles of its group, centred, and divided by the population deviation where it
    is over `least`. Quantiles and moments are joined back by group; no window or buffer holds a group together."""
    rows = df
    if clip:
        rows = joined(df, [by], value, [p / 100.0 for p in clip])
        rows = rows.withColumn("__v", F.greatest(F.col("__q")[0], F.least(F.col("__q")[1], F.col(value)))).drop("__q")
    else:
        rows = df.withColumn("__v", F.col(value))
    stat = rows.groupBy(by).agg(F.avg("__v").alias("__m"), F.stddev_pop("__v").alias("__s"))
    z = (F.col("__v") - F.col("__m")) / F.when(F.col("__s") > least, F.col("__s")).otherwise(1.0)
    return rows.join(stat, by).withColumn("z", z).drop("__v", "__m", "__s")


def zscore_positive(df: DataFrame, value: str, by: str, eps: float = 1e-8) -> DataFrame:
    """df with z by mean and deviation of the values over 0, of all where none is."""
    pos = F.when(F.col(value) > 0, F.col(value))
    stat = df.groupBy(by).agg(F.coalesce(F.avg(pos), F.avg(value)).alias("__m"), F.coalesce(F.stddev_pop(pos), F.stddev_pop(value)).alias("__s"))
    return df.join(stat, by).withColumn("z", (F.col(value) - F.col("__m")) / (F.col("__s") + eps)).drop("__m", "__s")


def zscore_plain(df: DataFrame, value: str, by: str, eps: float = 1e-8) -> DataFrame:
    """df with z by mean and deviation of all values of the group, eps added to the deviation."""
    stat = df.groupBy(by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(stat, by).withColumn("z", (F.col(value) - F.col("__m")) / (F.col("__s") + eps)).drop("__m", "__s")


def threshold_label(df: DataFrame, value: str, by: str, strict: bool = False) -> DataFrame:
    """df with a label by the group's mean: over 1.5 times 3, over 0.8 times 2, else 0. strict tests 0.8 last, as
    a known script does, so that 3 is never reached."""
    mean = df.groupBy(by).agg(F.avg(value).alias("__m"))
    low, high = F.col(value) > F.col("__m") * 0.8, F.col(value) > F.col("__m") * 1.5
    label = F.when(low, 2).when(high, 3) if strict else F.when(high, 3).when(low, 2)
    return df.join(mean, by).withColumn("label", label.otherwise(0)).drop("__m")


def tile_starts(size: Column | int, patch: Column | int, overlap: float = 0.5) -> Column:
    """Starts of tiles along an axis, the last one ending at the axis' end; [0] where the axis is shorter."""
    size, patch = (F.lit(x) if isinstance(x, int) else x.cast("int") for x in (size, patch))
    step = F.greatest(F.lit(1), F.floor(patch * (1 - overlap)).cast("int"))
    last = F.greatest(size - patch, F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), last, step), F.array(last))))


#: The labels of the vocabulary, background first.
LABELS = (0, 1, 2, 3, 4)


def merge_tiles(probs: DataFrame, keys: list[str], cls: str = "cls", p: str = "p", classes: tuple[int, ...] = LABELS) -> DataFrame:
    """(keys, label, p): classes' mean over overlapping tiles, the largest, the lowest class on a tie.

    One aggregation by keys holds a sum and a count for each of `classes`, so that what is shuffled is a row a voxel and
    task; other classes don't count, and keys with none of them are missing.
    """
    mean = probs.groupBy(*keys).agg(*[F.avg(F.when(F.col(cls) == c, F.col(p))).alias(f"__p{c}") for c in classes])
    each = [F.struct(F.col(f"__p{c}").alias("p"), F.lit(-c).alias("c")) for c in classes]
    best = mean.withColumn("__b", F.greatest(*each) if len(each) > 1 else each[0]).where("__b.p is not null")
    return best.select(*keys, (-F.col("__b.c")).alias("label"), F.col("__b.p").alias("p"))
