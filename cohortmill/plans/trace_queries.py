"""Queries of traces and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.operators import logs, traces
from cohortmill.plans.base import query

_UP, _DOWN = 60.0, 20.0


def _r(df, digits=6):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query(f"SELECT node_id, min(frame) FILTER (vm > {_UP}) * 2.0 AS t_act FROM v_trace GROUP BY 1")
def w05_activation_time(t):
    return traces.activation_time(t.v_trace, _UP, 2.0)


@query(f"""WITH s AS (SELECT node_id, min(frame) FILTER (vm > {_UP}) AS s, count_if(vm > {_UP}) AS n FROM v_trace GROUP BY 1),
o AS (SELECT node_id, any_value(n) AS n, min(frame - s) FILTER (frame >= s AND vm < {_DOWN}) AS o FROM v_trace JOIN s USING (node_id) GROUP BY 1) SELECT node_id, CASE WHEN n > 5 AND o > 2 THEN o * 2.0 END AS apd FROM o""")
def w06_apd(t):
    return traces.action_potential_duration(t.v_trace, _UP, _DOWN, dt=2.0)


def _points(t):
    act = traces.activation_time(t.v_trace, _UP, 1.0)
    p = t.v_node.select("mesh_id", "node_id", *[(F.col(c) * 1000).alias(c) for c in "xyz"])
    return p.join(act.select((F.col("node_id") % 81).alias("node_id"), "t_act").groupBy("node_id").agg(F.min("t_act").alias("t_act")), "node_id")


_POINTS = f"""a AS (SELECT node_id % 81 AS node_id, min(t) AS t_act FROM (SELECT node_id, min(frame) FILTER (vm > {_UP}) * 1.0 AS t FROM v_trace GROUP BY 1) GROUP BY 1),
p AS (SELECT mesh_id, n.node_id, x * 1000 AS x, y * 1000 AS y, z * 1000 AS z, t_act FROM v_node n JOIN a ON a.node_id = n.node_id)"""


@query(f"""WITH {_POINTS}, l AS (SELECT mesh_id, quantile_cont(t_act, 0.05) AS lo, quantile_cont(t_act, 0.95) AS hi, count(*) AS n FROM p WHERE t_act IS NOT NULL GROUP BY 1),
g AS (SELECT p.mesh_id, any_value(n) AS n, avg(x) FILTER (t_act > hi) - avg(x) FILTER (t_act < lo) AS dx, avg(y) FILTER (t_act > hi) - avg(y) FILTER (t_act < lo) AS dy, avg(z) FILTER (t_act > hi) - avg(z) FILTER (t_act < lo) AS dz, (avg(t_act) FILTER (t_act > hi) - avg(t_act) FILTER (t_act < lo)) / 1000 AS dt FROM p JOIN l USING (mesh_id) GROUP BY 1)
SELECT mesh_id, round(CASE WHEN n > 20 AND coalesce(dt, 0) > 0 THEN sqrt(dx * dx + dy * dy + dz * dz) / 10000 / dt ELSE 0 END, 6) AS cv FROM g""")
def w07_cv_percentile(t):
    return _r(traces.conduction_velocity_percentile(_points(t), "mesh_id", 20))


@query(f"""WITH {_POINTS}, c AS (SELECT mesh_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS n, max(t_act) - min(t_act) AS s FROM p WHERE t_act > 0 GROUP BY 1),
f AS (SELECT mesh_id, any_value(n) AS n, any_value(s) AS s, max(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)) AS far FROM p JOIN c USING (mesh_id) WHERE t_act > 0 GROUP BY 1)
SELECT m.mesh_id, round(CASE WHEN n > 10 AND s > 0 THEN far / s ELSE 0 END, 6) AS cv FROM (SELECT DISTINCT mesh_id FROM p) m LEFT JOIN f ON f.mesh_id = m.mesh_id""")
def w08_cv_span(t):
    return _r(traces.conduction_velocity_span(_points(t), "mesh_id"))


@query("SELECT event_type, round(regr_slope(value, user_id), 6) + 0.0 AS slope, round(regr_r2(value, user_id), 6) + 0.0 AS r2, round(regr_intercept(value, user_id), 6) + 0.0 AS intercept FROM events GROUP BY 1")
def w09_velocity_regression(t):
    return _r(traces.velocity_regression(t.events, "event_type", "value", "user_id"))


@query(f"WITH a AS (SELECT node_id, min(frame) FILTER (vm > {_UP}) * 2.0 AS t FROM v_trace GROUP BY 1) SELECT node_id % 10 AS g, round(avg(t), 6) AS mean, round(stddev_pop(t), 6) AS std, max(t) AS last, count(t) AS n_activated, round(100.0 * count(t) / count(*), 6) AS pct_activated FROM a GROUP BY 1")
def a21_activation_summary(t):
    act = traces.activation_time(t.v_trace, _UP, 2.0).withColumn("g", F.col("node_id") % 10)
    return _r(traces.activation_summary(act, ["g"]))


_A, _G = traces.affine(1.2, 1.5, 0.4)
_WK = f"""k AS (SELECT node_id, CAST(frame AS BIGINT) AS step, vm AS q FROM v_trace), w AS (SELECT node_id, step, q, CAST(80.0 AS DOUBLE) AS p FROM k WHERE step = 0
UNION ALL SELECT k.node_id, k.step, k.q, greatest(w.p * {_A!r} + greatest(k.q, 0) * {_G!r}, 0) FROM w JOIN k ON k.node_id = w.node_id AND k.step = w.step + 1)"""


def _wk(t):
    return traces.leaky_integrator(t.v_trace, "node_id", ["frame"], "vm", _A, _G, 80.0)


@query(f"WITH RECURSIVE {_WK} SELECT node_id, step, round(p, 6) AS p FROM w")
def w10_leaky_integrator(t):
    return _r(_wk(t).select("node_id", F.col("step").cast("long").alias("step"), "p"))


@query(f"WITH RECURSIVE {_WK} SELECT node_id, step, round(CASE WHEN q > 30 THEN p + least(0.9 * (q - 30), 60) ELSE greatest(p * 0.3, 5) END, 6) AS p_lv FROM w")
def w11_lv_pressure(t):
    return _r(_wk(t).select("node_id", F.col("step").cast("long").alias("step"), traces.ventricle_pressure(F.col("p"), F.col("q") - 30, 0.9).alias("p_lv")))


_WAVE = """v AS (SELECT p_partkey, k.i AS step, CAST(100 + p_size AS DOUBLE) AS d, CAST(50 + p_size AS DOUBLE) / 2 AS s, (k.i % 20) * 40.0 AS t FROM part CROSS JOIN range(40) AS k(i)),
w AS (SELECT p_partkey, step, CASE WHEN t < 280 THEN d - (d - s) * (3 * (t / 280) ** 2 - 2 * (t / 280) ** 3) ELSE s + (d - s) * (3 * ((t - 280) / 520) ** 2 - 2 * ((t - 280) / 520) ** 3) END AS volume FROM v)"""


def _wave(t):
    p = t.part.select("p_partkey", (100.0 + F.col("p_size")).alias("d"), ((50.0 + F.col("p_size")) / 2).alias("s"))
    return traces.volume_waveform(p, "p_partkey", "d", "s", steps=20, bcl=800.0, cycles=2)


@query(f"WITH {_WAVE} SELECT p_partkey, step, round(volume, 6) AS volume, round(coalesce(lag(volume) OVER (PARTITION BY p_partkey ORDER BY step) - volume, 0), 6) + 0.0 AS flow FROM w")
def w12_volume_waveform(t):
    return _r(_wave(t).select("p_partkey", F.col("step").cast("long").alias("step"), "volume", "flow"))


@query("SELECT p_partkey, round(greatest(80, least(200, p_retailprice * 0.15)), 6) AS v_ed, round(greatest(80, least(200, p_retailprice * 0.15)) * (1 - greatest(0.25, least(0.75, 0.3 + 0.3 * p_size / 30.0))), 6) AS v_es FROM part")
def w13_fallback_volumes(t):
    d, s = traces.fallback_volumes(F.col("p_size") * 135.0 / 30.0, F.col("p_retailprice") * 0.15 / 0.4e-3)
    return _r(t.part.select("p_partkey", d.alias("v_ed"), s.alias("v_es")))


@query("""WITH a AS (SELECT idx, p1 AS d, p1 * p2 AS s, greatest(0.8, least(1.2, 1 + 0.1 * (95 - out1 / 10000) / 95)) AS f FROM v_doe), b AS (SELECT idx, d * f AS v_ed_new, 100.0 * (d - s) / d AS ef_before, 100.0 * (d * f - s * f) / (d * f) AS ef_after FROM a)
SELECT idx, round(v_ed_new, 5) AS v_ed_new, round(ef_before, 5) AS ef_before, round(ef_after, 5) AS ef_after, CASE WHEN abs(ef_after - ef_before) < 1 THEN 2 ELSE 10 END AS rounds FROM b""")
def w14_pressure_feedback(t):
    d = t.v_doe.select("idx", "p1", (F.col("p1") * F.col("p2")).alias("s"), (F.col("out1") / 10000).alias("pm"))
    return _r(traces.pressure_feedback(d, "p1", "s", "pm").select("idx", "v_ed_new", "ef_before", "ef_after", "rounds"), 5)


_CYCLE = f"""{_WAVE}, x AS (SELECT p_partkey, step, volume, volume * 0.9 AS p_lv, volume * 0.8 AS p_ao, (lead(volume) OVER (PARTITION BY p_partkey ORDER BY step) - volume) * 0.9 / 0.04 AS r FROM w WHERE step >= 20),
m AS (SELECT p_partkey, max(volume) AS edv, min(volume) AS esv, max(p_ao) AS p_sys, min(p_ao) AS p_dia, avg(p_ao) AS p_mean, max(r) AS dp FROM x GROUP BY 1)"""


def _cycle(t):
    x = _wave(t).where("step >= 20").select("p_partkey", "step", "volume", (F.col("volume") * 0.9).alias("p_lv"), (F.col("volume") * 0.8).alias("p_ao"))
    return traces.cycle_metrics(x, "p_partkey", 72.0, 40.0)


@query(f"WITH {_CYCLE} SELECT p_partkey, round(edv, 5) AS edv, round(esv, 5) AS esv, round(edv - esv, 5) AS sv, round(100 * (edv - esv) / edv, 5) AS ef, round(p_sys, 5) AS p_sys, round(p_dia, 5) AS p_dia, round(p_mean, 5) AS p_mean, round(dp, 5) AS dp_dt_max, round((edv - esv) * 72 / 1000, 5) AS co FROM m")
def a18_cycle_metrics(t):
    return _r(_cycle(t), 5)


@query(f"WITH {_CYCLE}, f AS (SELECT p_partkey, p_sys BETWEEN 60 AND 300 AS a, p_dia BETWEEN 50 AND 110 AS b, 100 * (edv - esv) / edv BETWEEN 25 AND 85 AS c, edv BETWEEN 60 AND 220 AS d, edv > esv AS e FROM m) SELECT p_partkey, a AS p_systolic, b AS p_diastolic, c AS ef_ok, d AS edv_ok, e AS coherent, a AND b AND c AND d AND e AS slo_passed FROM f")
def a19_slo_flags(t):
    s = traces.slo_flags(_cycle(t))
    return s.select("p_partkey", "slo.p_systolic", "slo.p_diastolic", F.col("slo.ef").alias("ef_ok"), F.col("slo.edv").alias("edv_ok"), F.col("slo.pv_loop_coherent").alias("coherent"), "slo_passed")


@query("SELECT p_partkey, p_retailprice / 1000 BETWEEN 0.1 AND 2.0 AND p_size * 10 BETWEEN 200 AND 400 AS ok FROM part")
def a20_ep_slo(t):
    return t.part.select("p_partkey", traces.ep_slo(F.col("p_retailprice") / 1000, F.col("p_size") * 10).alias("ok"))


_VECTOR = ["1", "2", "3", "4", "5", "100 * (edv - esv) / edv", "edv", "esv", "(edv - esv)", "p_sys", "p_dia", "p_mean", "dp", "(edv - esv) * 72 / 1000"]


@query(f"WITH {_CYCLE} SELECT p_partkey, 14 AS n, round({' + '.join(_VECTOR)}, 4) AS total, round({' + '.join(f'{k + 1} * {x}' for k, x in enumerate(_VECTOR))}, 4) AS by_place FROM m")
def a22_output_vector(t):
    """by_place weighs each value by its place, so that the order counts."""
    m = _cycle(t).withColumns({c: F.lit(float(k + 1)) for k, c in enumerate(traces.EP_FIELDS)})
    v = traces.output_vector()
    by_place = F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return m.select("p_partkey", F.size(v).alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(by_place, 4).alias("by_place"))


_LOG = """e AS (SELECT run_id, seq // 3 AS epoch, max(CAST(nullif(regexp_extract(line, 'train_loss ([-0-9.]+)', 1), '') AS DOUBLE)) AS train_loss,
 max(CAST(nullif(regexp_extract(line, 'float32.([0-9.]+)', 1), '') AS DOUBLE)) AS dice_rv, max(CAST(nullif(regexp_extract(line, '\\), ([0-9.]+),', 1), '') AS DOUBLE)) AS dice_myo FROM v_log GROUP BY 1, 2)"""


@query(f"WITH {_LOG} SELECT run_id, CAST(epoch AS BIGINT) AS epoch, train_loss, dice_rv, dice_myo, CAST(0.95 AS DOUBLE) AS dice_lv FROM e")
def s08_parse_epochs(t):
    return logs.parse_epochs(t.v_log).select("run_id", "epoch", "train_loss", "dice_rv", "dice_myo", "dice_lv")


@query(f"WITH {_LOG} SELECT run_id, CAST(epoch AS BIGINT) AS epoch, max(dice_rv) OVER (PARTITION BY run_id ORDER BY epoch) AS best, dice_rv > coalesce(max(dice_rv) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS new_best FROM e")
def w18_epoch_best(t):
    return logs.epoch_best(logs.parse_epochs(t.v_log), "dice_rv").select("run_id", "epoch", "best", "new_best")


@query("SELECT event_id, round(0.01 * (1 - (event_id % 1000) / 1000.0) ** 0.9, 8) AS lr FROM events")
def w19_lr_schedule(t):
    return t.events.select("event_id", F.round(logs.lr_schedule(F.col("event_id") % 1000, 1000), 8).alias("lr"))


def _steps(t):
    """Solver lines made from orders' items, one job an order."""
    kind = F.when(F.col("l_linenumber") == 3, F.lit("mechanics.fenicsx.load_step_reject")).otherwise(F.lit("mechanics.fenicsx.load_step"))
    line = F.concat(F.lit("2024-01-31 [info] "), kind, F.lit(" lam="), (F.col("l_linenumber") * 0.25).cast("string"), F.lit(" its="), F.col("l_quantity").cast("int").cast("string"), F.lit(" min_J=0."), F.col("l_linenumber").cast("string"), F.lit(" dlam=0.1"))
    return t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("seq"), line.alias("line"))


@query("SELECT l_orderkey AS run_id, l_linenumber AS seq, CASE WHEN l_linenumber = 3 THEN 'reject' ELSE 'accept' END AS kind, l_linenumber * 0.25::DOUBLE AS lam, CAST(CAST(trunc(l_quantity) AS INT) AS DOUBLE) AS its, CAST('0.' || l_linenumber AS DOUBLE) AS min_j FROM lineitem")
def s09_parse_load_steps(t):
    return logs.parse_load_steps(_steps(t)).select("run_id", "seq", "kind", "lam", "its", "min_j")


@query("""SELECT l_orderkey AS run_id, count_if(l_linenumber <> 3) AS n_accepted, count_if(l_linenumber = 3) AS n_rejected, CAST(coalesce(sum(trunc(l_quantity)) FILTER (l_linenumber <> 3), 0) AS DOUBLE) AS iterations,
 max(l_linenumber) FILTER (l_linenumber <> 3) * 0.25::DOUBLE AS lam, coalesce(max(l_linenumber) FILTER (l_linenumber <> 3) >= 4, false) AS converged FROM lineitem GROUP BY 1""")
def a26_load_step_summary(t):
    return logs.load_step_summary(logs.parse_load_steps(_steps(t))).drop("min_j")
