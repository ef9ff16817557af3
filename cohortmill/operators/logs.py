"""Run logs: lines (run_id, seq, line) to epochs and load steps, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed formats of the lines of a training log.
EPOCH = r"\bEpoch (\d+)\s*$"
NUMBERS = {"lr": r"Current learning rate:\s*([-+\d.eE]+)", "train_loss": r"train_loss\s+([-+\d.eE]+)", "val_loss": r"val_loss\s+([-+\d.eE]+)", "ema_dice": r"New best EMA pseudo Dice:\s*([-+\d.eE]+)", "epoch_time_s": r"Epoch time:\s*([-+\d.eE]+)"}
DICE = r"Pseudo dice \[(.*)\]"
DICE_NAMES = ("dice_rv", "dice_myo", "dice_lv")


def line_fields(lines: DataFrame) -> DataFrame:
    """lines with epoch_mark and the value that each line holds, null elsewhere."""
    value = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit("")).try_cast("double")
    dice = F.regexp_replace(F.regexp_replace(F.regexp_extract("line", DICE, 1), r"np\.float32\(", ""), r"\)", "")
    parts = F.split(dice, r",\s*")
    cols = {"epoch_mark": F.nullif(F.regexp_extract("line", EPOCH, 1), F.lit("")).try_cast("long")}
    cols |= {k: value(p) for k, p in NUMBERS.items()}
    cols |= {k: F.try_element_at(parts, F.lit(i + 1)).try_cast("double") for i, k in enumerate(DICE_NAMES)}
    return lines.withColumns(cols)


def parse_epochs(lines: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """(run, epoch, lr, losses, dice .., ema_dice, epoch_time_s): a line belongs to the last Epoch line before it; an
    epoch without train_loss is left out. A running count by run, then one aggregation."""
    rows = line_fields(lines)
    w = Window.partitionBy(run).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__e", F.count("epoch_mark").over(w)).where("__e > 0")
    names = [*NUMBERS, *DICE_NAMES]
    out = rows.groupBy(run, "__e").agg(F.max("epoch_mark").alias("epoch"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in names])
    return out.where("train_loss is not null").drop("__e")


def epoch_best(epochs: DataFrame, metric: str, run: str = "run_id", order: str = "epoch") -> DataFrame:
    """epochs with the running best of a metric and whether the row is a new best."""
    w = Window.partitionBy(run).orderBy(order)
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return epochs.withColumns({"best": F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, 0)), "new_best": F.col(metric) > F.coalesce(before, F.lit(float("-inf")))})


def lr_schedule(epoch, epochs: int, lr0: float = 0.01, power: float = 0.9):
    """The polynomial decay of the learning rate."""
    return F.lit(lr0) * F.pow(1.0 - epoch / float(epochs), F.lit(power))


STEP = "mechanics.fenicsx.load_step"


def parse_load_steps(lines: DataFrame) -> DataFrame:
    """lines with kind (accept, reject) and the key=value fields of load-step lines; other lines are dropped."""
    field = lambda k: F.nullif(F.regexp_extract("line", rf"(?:^|\s){k}=([^\s]+)", 1), F.lit("")).try_cast("double")
    rows = lines.where(F.col("line").contains(STEP))
    kind = F.when(F.col("line").contains(STEP + "_reject"), "reject").otherwise("accept")
    return rows.withColumns({"kind": kind, **{k.lower(): field(k) for k in ("lam", "dlam", "its", "min_J", "T_act_kPa", "domain_err_total")}})


def load_step_summary(steps: DataFrame, job: str = "run_id", seq: str = "seq") -> DataFrame:
    """Per job: accepted and rejected steps, iterations, the last lam and min_j, and whether lam reached 1."""
    ok = F.col("kind") == "accept"
    last = lambda c: F.max_by(c, F.when(ok, F.col(seq)))
    out = steps.groupBy(job).agg(F.count_if(ok).alias("n_accepted"), F.count_if(~ok).alias("n_rejected"), F.coalesce(F.sum(F.when(ok, F.col("its"))), F.lit(0.0)).alias("iterations"), last("lam").alias("lam"), last("min_j").alias("min_j"))
    return out.withColumn("converged", F.coalesce(F.col("lam") >= 1 - 1e-9, F.lit(False)))
