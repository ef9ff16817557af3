"""Time series per node or patient: activation, action potentials, conduction, pressure and cycle measures."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmill.operators.quantiles import exact_quantiles
from cohortmill.session import written

MMHG = 133.322


def activation_time(vm: DataFrame, threshold: float = -10.0, dt: float = 1.0) -> DataFrame:
    """(node_id, t_act): time of the first frame above the threshold, null if there is none; an aggregation, no window."""
    return vm.groupBy("node_id").agg((F.min(F.when(F.col("vm") > threshold, F.col("frame"))) * F.lit(dt)).alias("t_act"))


def action_potential_duration(vm: DataFrame, up: float = -10.0, down: float = -60.0, least_above: int = 5, least_offset: int = 2, dt: float = 1.0) -> DataFrame:
    """(node_id, apd): from the first frame above `up` to the first below `down` after it, for nodes with more than
    `least_above` frames above and an offset over `least_offset` frames; null otherwise."""
    start = vm.groupBy("node_id").agg(F.min(F.when(F.col("vm") > up, F.col("frame"))).alias("__s"), F.count_if(F.col("vm") > up).alias("__n"))
    off = F.min(F.when((F.col("frame") >= F.col("__s")) & (F.col("vm") < down), F.col("frame") - F.col("__s")))
    out = vm.join(start, "node_id").groupBy("node_id", "__n").agg(off.alias("__o"))
    return out.select("node_id", F.when((F.col("__n") > least_above) & (F.col("__o") > least_offset), F.col("__o") * F.lit(dt)).alias("apd"))


def mean_apd(apd: DataFrame) -> DataFrame:
    return apd.agg(F.coalesce(F.avg("apd"), F.lit(0.0)).alias("apd_mean"), F.count("apd").alias("n"))


def conduction_velocity_percentile(points: DataFrame, by: str, least: int = 100) -> DataFrame:
    """(by, cv): distance between the centroids of the earliest and the latest twentieth over the gap of their mean
    times; coordinates in micrometres, times in ms, cm/s. 0 for groups of at most `least` times or without a gap."""
    known = points.where("t_act is not null")
    known, _ = written(known.select(by, *"xyz", "t_act"), "activated")
    lim = exact_quantiles(known, [by], "t_act", [0.05, 0.95]).select(by, F.col("n").alias("__n"), F.col("q").alias("__p"))
    j = known.join(lim, by)
    early, late = F.col("t_act") < F.col("__p")[0], F.col("t_act") > F.col("__p")[1]
    mean = lambda ok, c: F.avg(F.when(ok, F.col(c)))
    agg = j.groupBy(by, "__n").agg(*[(mean(late, c) - mean(early, c)).alias(f"d{c}") for c in "xyz"], ((mean(late, "t_act") - mean(early, "t_act")) / 1000.0).alias("dt"))
    dist = F.sqrt(sum((F.col(f"d{c}") * F.col(f"d{c}") for c in "xyz"), F.lit(0.0))) / 10000.0
    cv = agg.select(by, F.when((F.col("__n") > least) & (F.col("dt") > 0), dist / F.col("dt")).alias("cv"))
    return points.select(by).distinct().join(cv, by, "left").fillna(0.0, ["cv"])


def conduction_velocity_span(points: DataFrame, by: str, least: int = 10) -> DataFrame:
    """(by, cv): the largest distance to the centroid of activated points over the span of their times."""
    act = points.where("t_act > 0")
    c = act.groupBy(by).agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"], F.count("*").alias("n"), (F.max("t_act") - F.min("t_act")).alias("span"))
    d = F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz"), F.lit(0.0)))
    out = act.join(c, by).groupBy(by, "n", "span").agg(F.max(d).alias("far"))
    cv = out.select(by, F.when((F.col("n") > least) & (F.col("span") > 0), F.col("far") / F.col("span")).alias("cv"))
    return points.select(by).distinct().join(cv, by, "left").fillna(0.0, ["cv"])


def velocity_regression(points: DataFrame, by: str, distance: str, time: str) -> DataFrame:
    """(by, slope, r2, intercept) of distance on time."""
    return points.groupBy(by).agg(F.regr_slope(distance, time).alias("slope"), F.regr_r2(distance, time).alias("r2"), F.regr_intercept(distance, time).alias("intercept"))


def activation_summary(times: DataFrame, by: list[str], t: str = "t_act") -> DataFrame:
    """Mean, population deviation and largest activation time, how many of all are activated and their share."""
    return times.groupBy(*by).agg(F.avg(t).alias("mean"), F.stddev_pop(t).alias("std"), F.max(t).alias("last"), F.count(t).alias("n_activated"), (100.0 * F.count(t) / F.count("*")).alias("pct_activated"))


def affine(resistance: float, compliance: float, dt: float) -> tuple[float, float]:
    """a, g of P' = a P + g Q, which a fourth-order step of dP/dt = (Q - P/R)/C is for constant Q."""
    x = dt / (resistance * compliance)
    a = 1 - x + x * x / 2 - x**3 / 6 + x**4 / 24
    return a, resistance * (1 - a)


#: Steps of a series that one window sums up.
BLOCK = 4096


def leaky_integrator(flow: DataFrame, by: str, order: list[str], q: str, a: float, g: float, start: float, block: int = BLOCK) -> DataFrame:
    """(by, step, q, p): pressure of a leaky integrator after each step of each series, the first step at `start` (0 or
    more); negative and null flows count as 0.

    A step is the affine map p -> a p + g q, and maps of a run of steps are again one: a to the number of steps, and what
    the run alone would leave. Series are cut into blocks of steps; in a block that is a**k times a running sum of
    g q / a**k, whose powers stay in range; a block's end is carried to the next one by a fold over blocks, whose number is a
    `block`-th of the steps. So a series is not the unit of parallel work, its blocks are. Steps are numbered by counts
    of ranges of an integer order before them; other orders are first numbered by a window over the series.
    """
    if start < 0 or not a > 0:
        raise ValueError("start below 0 or a not over 0")
    block = max(1, min(block, int(300 / max(abs(math.log(a)), 1e-9))))
    rows = flow.select(by, *order, F.col(q).cast("double").alias("__q"))
    whole = len(order) == 1 and rows.schema[order[0]].dataType.typeName() in ("byte", "short", "integer", "long")
    rows = rows.withColumn("__b", F.floor(F.col(order[0]) / block) if whole else F.lit(0).cast("long"))
    sizes = rows.groupBy(by, "__b").agg(F.count("*").alias("__n")).withColumn("__before", F.sum("__n").over(Window.partitionBy(by).orderBy("__b")) - F.col("__n"))
    rank = F.row_number().over(Window.partitionBy(by, "__b").orderBy(*order, "__q"))
    rows = rows.withColumn("__r", rank).join(sizes.select(F.col(by).alias("__by"), F.col("__b").alias("__bb"), "__before"), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__b") == F.col("__bb")))
    rows = rows.withColumn("step", F.col("__before") + F.col("__r") - 1).select(by, "step", F.col("__q").alias("q"), F.floor(F.col("step") / block).alias("__b"))
    k = (F.col("step") - F.col("__b") * block).cast("double")
    gain = F.when(F.col("step") == 0, F.lit(float(start))).otherwise(F.greatest("q", F.lit(0.0)) * g)
    run = F.sum(gain / F.pow(F.lit(a), k)).over(Window.partitionBy(by, "__b").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    alone, path = written(rows.withColumn("__p", F.pow(F.lit(a), k) * run), "blocks")
    ends = alone.groupBy(by, "__b").agg(F.count("*").alias("n"), F.max_by("__p", "step").alias("end"))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__b")
        held, out = 0.0, []
        for n, end in zip(pdf["n"].tolist(), pdf["end"].tolist(), strict=True):
            out.append(held)
            held = end + a**n * held
        return pdf[[by, "__b"]].assign(__c=out)

    kind = rows.schema[by].dataType.simpleString()
    carried = ends.groupBy(by).applyInPandas(carry, f"`{by}` {kind}, `__b` long, `__c` double")
    out = alone.alias("x").join(carried.alias("y"), [F.col(f"x.{by}").eqNullSafe(F.col(f"y.{by}")), F.col("x.__b") == F.col("y.__b")])
    return out.select(F.col(f"x.{by}").alias(by), F.col("step").cast("int").alias("step"), "q", (F.col("__p") + F.col("__c") * F.pow(F.lit(a), (F.col("step") - F.col("x.__b") * block + 1).cast("double"))).alias("p"))


def ventricle_pressure(p: Column, q: Column, impedance: float, drop: float = 60.0, share: float = 0.3, floor: float = 5.0) -> Column:
    """While the valve is open the aortic pressure and the drop over it (limited), else a share of it (at least floor)."""
    return F.when(q > 0, p + F.least(F.lit(float(impedance)) * q, F.lit(float(drop)))).otherwise(F.greatest(p * share, F.lit(float(floor))))


def volume_waveform(params: DataFrame, key: str, v_ed: str, v_es: str, steps: int = 100, bcl: float = 800.0, t_sys: float = 300.0, cycles: int = 1) -> DataFrame:
    """(key, step, t_ms, volume, flow): a smooth fall to v_es until t_sys (35 % of short beats) and rise back, tiled;
    flow is the fall of volume from the step before, 0 at first."""
    end = min(t_sys, 0.35 * bcl)
    rows = params.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps * cycles - 1))))
    t = (F.col("step") % steps) * (bcl / steps)
    fall, rise = t / end, (t - end) / (bcl - end)
    smooth = lambda x: 3 * x * x - 2 * x * x * x
    sv = F.col(v_ed) - F.col(v_es)
    rows = rows.withColumn("volume", F.when(t < end, F.col(v_ed) - sv * smooth(fall)).otherwise(F.col(v_es) + sv * smooth(rise)))
    before = F.lag("volume").over(Window.partitionBy(key).orderBy("step"))
    return rows.select(key, "step", (F.col("step") * (bcl / steps)).alias("t_ms"), "volume", F.coalesce(before - F.col("volume"), F.lit(0.0)).alias("flow"))


def fallback_volumes(t_max: Column, box: Column) -> tuple[Column, Column]:
    """Volumes at end of filling and of ejection where no mechanics are known, from the tension and the box in mm3."""
    v_ed = F.greatest(F.lit(80.0), F.least(F.lit(200.0), box * 0.4e-3))
    ef = F.greatest(F.lit(0.25), F.least(F.lit(0.75), 0.3 + 0.3 * t_max / 135.0))
    return v_ed, v_ed * (1 - ef)


def pressure_correction(p_mean: Column, target: float = 95.0) -> Column:
    """The factor on volume that a mean pressure off its target asks for, within 0.8 and 1.2."""
    return F.greatest(F.lit(0.8), F.least(F.lit(1.2), 1.0 + 0.1 * (target - p_mean) / target))


def pressure_feedback(runs: DataFrame, v_ed: str, v_es: str, p_mean: str, stop: float = 1.0, most: int = 10) -> DataFrame:
    """runs with corrected volumes, ef before and after, and rounds.

    Scaling both volumes leaves the ejection fraction as it is, so the fixed point's second round meets its stop (a
    change under `stop`): two rounds, without a loop on the driver. A row whose change is not under it has `most`.
    """
    f = pressure_correction(F.col(p_mean))
    ef = lambda d, s: 100.0 * (d - s) / d
    out = runs.withColumns({"v_ed_new": F.col(v_ed) * f, "v_es_new": F.col(v_es) * f})
    out = out.withColumns({"ef_before": ef(F.col(v_ed), F.col(v_es)), "ef_after": ef(F.col("v_ed_new"), F.col("v_es_new"))})
    return out.withColumn("rounds", F.when(F.abs(F.col("ef_after") - F.col("ef_before")) < stop, 2).otherwise(most))


def cycle_metrics(trace: DataFrame, by: str, heart_rate: float, dt_ms: float, legacy_output: bool = False) -> DataFrame:
    """Per series of one cycle (step, volume, p_lv, p_ao): volumes, stroke volume, ejection fraction, pressures, the
    steepest rise of pressure a second, and cardiac output in L/min. legacy_output gives the output a thousandth
    as large, as a known implementation does."""
    rise = (F.lead("p_lv").over(Window.partitionBy(by).orderBy("step")) - F.col("p_lv")) / (dt_ms * 1e-3)
    m = trace.withColumn("__r", rise).groupBy(by).agg(
        F.max("volume").alias("edv"), F.min("volume").alias("esv"), F.max("p_ao").alias("p_sys"), F.min("p_ao").alias("p_dia"), F.avg("p_ao").alias("p_mean"), F.coalesce(F.max("__r"), F.lit(0.0)).alias("dp_dt_max")
    )
    m = m.withColumn("sv", F.col("edv") - F.col("esv"))
    return m.withColumns({"ef": F.when(F.col("edv") > 0, 100.0 * F.col("sv") / F.col("edv")).otherwise(0.0), "co": F.col("sv") * heart_rate / (1e6 if legacy_output else 1e3)})


def slo_flags(m: DataFrame) -> DataFrame:
    """m with slo: a struct of flags for pressures, ejection fraction, volume and coherence, and slo_passed."""
    flags = {
        "p_systolic": F.col("p_sys").between(60, 300), "p_diastolic": F.col("p_dia").between(50, 110), "ef": F.col("ef").between(25, 85),
        "edv": F.col("edv").between(60, 220), "pv_loop_coherent": (F.col("edv") > F.col("esv")) & (F.col("sv") > 0),
    }
    every = F.lit(True)
    for f in flags.values():
        every = every & F.coalesce(f, F.lit(False))
    return m.withColumns({"slo": F.struct(*[f.alias(k) for k, f in flags.items()]), "slo_passed": every})


def ep_slo(cv: Column, apd: Column) -> Column:
    return cv.between(0.10, 2.0) & apd.between(200, 400)


EP_FIELDS = ("cv_ms", "apd90_ms", "act_mean", "act_std", "act_max")
CYCLE_FIELDS = ("ef", "edv", "esv", "sv", "p_sys", "p_dia", "p_mean", "dp_dt_max", "co")


def output_vector() -> Column:
    """The five electrical and nine haemodynamic scalars in their fixed order."""
    return F.array(*[F.col(c).cast("double") for c in (*EP_FIELDS, *CYCLE_FIELDS)])
