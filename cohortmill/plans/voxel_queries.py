"""Queries of voxel tables, validation and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.operators import validate, voxels
from cohortmill.plans.base import query

BOUNDS = {"l_quantity": (5.0, 45.0), "l_discount": (0.01, 0.09), "l_tax": (0.0, 0.07)}
LABELS = [1, 2, 3]


def _spacing():
    return F.lit(4.5)


def _pairs(t):
    v = t.v_vox
    grid = ["case_id", "z", "y", "x"]
    return voxels.pair_labels(v.select(*grid, F.col("label_pred").alias("pred")), v.select(*grid, F.col("label_true").alias("truth")))


_DICE = """SELECT case_id, l AS label, CASE WHEN s = 0 THEN 1.0 ELSE 2.0 * i / s END AS dice FROM (
  SELECT case_id, l, count_if(label_pred = l AND label_true = l) AS i, count_if(label_pred = l) + count_if(label_true = l) AS s FROM v_vox CROSS JOIN (VALUES (1), (2), (3)) AS q(l) GROUP BY 1, 2)"""


@query(f"""WITH d AS ({_DICE}), v AS (SELECT case_id, l AS label, count_if(label_true = l) * 4.5 / 1000 AS vol FROM v_vox CROSS JOIN (VALUES (1), (2), (3)) AS q(l) GROUP BY 1, 2)
SELECT d.case_id, d.label, round(v.vol, 6) AS volume_ml, round(d.dice, 6) AS dice, d.dice >= CASE d.label WHEN 1 THEN 0.85 ELSE 0.9 END AS slo FROM d JOIN v ON v.case_id = d.case_id AND v.label = d.label""")
def entry_cohort_report(t):
    """Per case and label: true volume, Dice and whether it meets its limit, in one scan of the voxels."""
    v = t.v_vox
    vol = voxels.label_volumes(v, "label_true", LABELS, _spacing())
    long = vol.select("case_id", F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"vol_{x}").alias("vol")) for x in LABELS])))
    d = voxels.dice(v, LABELS, pred="label_pred", truth="label_true")
    limit = F.when(F.col("label") == 1, voxels.DICE_SLO[1]).otherwise(voxels.DICE_SLO[2])
    return d.join(long, ["case_id", "label"]).select("case_id", "label", F.round("vol", 6).alias("volume_ml"), F.round("dice", 6).alias("dice"), (F.col("dice") >= limit).alias("slo"))


@query("SELECT case_id, " + ", ".join(f"round(count_if(label_true = {v}) * 4.5 / 1000, 6) AS vol_{v}" for v in (1, 2, 3, 4)) + " FROM v_vox GROUP BY 1")
def a01_label_volumes(t):
    out = voxels.label_volumes(t.v_vox, "label_true", [1, 2, 3, 4], _spacing())
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("SELECT case_id, round(CASE WHEN a + b > 0 THEN 100.0 * a / (a + b) ELSE 0 END, 6) AS scar_pct FROM (SELECT case_id, count_if(label_true = 1) AS a, count_if(label_true = 2) AS b FROM v_vox GROUP BY 1)")
def a02_scar_burden(t):
    n = t.v_vox.groupBy("case_id").agg(F.count_if(F.col("label_true") == 1).alias("a"), F.count_if(F.col("label_true") == 2).alias("b"))
    return n.select("case_id", F.round(voxels.scar_burden(F.col("a"), F.col("b")), 6).alias("scar_pct"))


@query("SELECT case_id, label_true, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY case_id), 6) AS pct FROM v_vox GROUP BY 1, 2")
def a03_label_histogram(t):
    return voxels.label_histogram(t.v_vox, "label_true").withColumn("pct", F.round("pct", 6))


@query(f"SELECT case_id, label, round(dice, 6) AS dice FROM ({_DICE})")
def a04_dice(t):
    return voxels.dice(_pairs(t), LABELS).withColumn("dice", F.round("dice", 6))


@query("""SELECT case_id, l AS label, round((2.0 * count_if(label_pred = l AND label_true = l) + 1e-5) / (count_if(label_pred = l) + count_if(label_true = l) + 1e-5), 6) AS smooth_both,
 round(2.0 * count_if(label_pred = l AND label_true = l) / (count_if(label_pred = l) + count_if(label_true = l) + 1e-5), 6) AS smooth_denominator FROM v_vox CROSS JOIN (VALUES (1), (2), (4)) AS q(l) GROUP BY 1, 2""")
def a04_dice_policies(t):
    v = t.v_vox
    a, b = (voxels.dice(v, [1, 2, 4], p, "label_pred", "label_true").select("case_id", "label", F.round("dice", 6).alias(p)) for p in ("smooth_both", "smooth_denominator"))
    return a.join(b, ["case_id", "label"])


@query(f"SELECT label, round(avg(dice), 6) AS mean_dice, count(*) AS n_cases, count_if(dice >= CASE label WHEN 1 THEN 0.85 ELSE 0.9 END) AS n_pass, avg(dice) >= any_value(CASE label WHEN 1 THEN 0.85 ELSE 0.9 END) AS slo FROM ({_DICE}) GROUP BY label")
def a05_dice_report(t):
    return voxels.dice_report(voxels.dice(t.v_vox, LABELS, pred="label_pred", truth="label_true")).withColumn("mean_dice", F.round("mean_dice", 6))


@query("SELECT case_id, count(*) AS n, count_if(label_pred = label_true) AS n_equal FROM v_vox WHERE x < 20 GROUP BY 1")
def j06_pair_pred_truth(t):
    v = t.v_vox
    grid = ["case_id", "z", "y", "x"]
    p = voxels.pair_labels(v.where("x < 20").select(*grid, F.col("label_pred").alias("pred")), v.select(*grid, F.col("label_true").alias("truth")))
    return p.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("truth")).alias("n_equal"))


@query("""SELECT r.case_id, coalesce(l.label_true, 0) AS label_true, count(*) AS n FROM v_vox r LEFT JOIN v_vox l ON l.case_id = r.case_id
 AND l.z = CAST(floor(r.z * 0.5 + 0.5) AS INT) AND l.y = CAST(floor(r.y * 1.25 + 0.5) AS INT) AND l.x = r.x GROUP BY 1, 2""")
def j09_resample_nearest(t):
    ref = t.v_vox.select("case_id", "z", "y", "x")
    out = voxels.resample_nearest(ref, t.v_vox, {"z": 0.5, "y": 1.25, "x": 1.0}, "label_true")
    return out.groupBy("case_id", "label_true").agg(F.count("*").alias("n"))


@query("SELECT case_id, count(*) AS n FROM v_vox WHERE case_id IN (SELECT case_id FROM v_vox GROUP BY 1 HAVING count_if(label_pred > 0) > 500) GROUP BY 1")
def k04_annotated_frames(t):
    return voxels.annotated_frames(t.v_vox, "label_pred", 500).groupBy("case_id").agg(F.count("*").alias("n"))


@query("SELECT case_id, CASE label_true WHEN 1 THEN 3 WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS label, count(*) AS n FROM v_vox GROUP BY 1, 2")
def p03_remap_labels(t):
    return t.v_vox.select("case_id", validate.remap(F.col("label_true"), {1: 3, 3: 1, 2: 2}).alias("label")).groupBy("case_id", "label").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT s_suppkey AS case_id, z.i AS z, y.i AS y, x.i AS x FROM supplier CROSS JOIN range(16) AS z(i) CROSS JOIN range(20) AS y(i) CROSS JOIN range(24) AS x(i))
SELECT g.case_id, count(*) AS n, count_if(coalesce(v.label_true, 0) > 0) AS n_label, round(sum(coalesce(v.intensity, 0)), 3) AS total FROM g LEFT JOIN v_vox v ON v.case_id = g.case_id AND v.z + 2 = g.z AND v.y - 2 = g.y AND v.x = g.x GROUP BY 1""")
def p08_crop_or_pad(t):
    size, target = {"z": 12, "y": 24, "x": 24}, {"z": 16, "y": 20, "x": 24}
    out = voxels.dense(voxels.crop_or_pad(t.v_vox, target, size), target, ["label_true", "intensity"])
    return out.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("label_true") > 0).alias("n_label"), F.round(F.sum("intensity"), 3).alias("total"))


@query("""SELECT case_id, CAST(sum((CASE WHEN case_id % 2 = 0 THEN 11 - z ELSE z END) * label_true) AS BIGINT) AS mz, CAST(sum((CASE WHEN case_id % 3 = 0 THEN 23 - y ELSE y END) * label_true) AS BIGINT) AS my,
 CAST(sum((CASE WHEN case_id % 5 = 0 THEN 23 - x ELSE x END) * label_true) AS BIGINT) AS mx FROM v_vox GROUP BY 1""")
def p09_flip(t):
    out = voxels.flip(t.v_vox, {"z": 12, "y": 24, "x": 24}, {a: F.col("case_id") % n == 0 for a, n in (("z", 2), ("y", 3), ("x", 5))})
    return out.groupBy("case_id").agg(*[F.sum(F.col(a) * F.col("label_true")).cast("long").alias(f"m{a}") for a in ("z", "y", "x")])


@query("""WITH p AS (SELECT user_id, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY 1),
c AS (SELECT event_id, user_id, greatest(lo, least(hi, value)) AS v FROM events JOIN p USING (user_id)), s AS (SELECT user_id, avg(v) AS m, stddev_pop(v) AS s FROM c GROUP BY 1)
SELECT event_id, round((v - m) / CASE WHEN s > 1e-8 THEN s ELSE 1 END, 6) + 0.0 AS z FROM c JOIN s USING (user_id)""")
def w01_zscore(t):
    return voxels.zscore(t.events, "value", "user_id").select("event_id", (F.round("z", 6) + 0.0).alias("z"))


@query("""WITH s AS (SELECT user_id, coalesce(avg(v) FILTER (v > 0), avg(v)) AS m, coalesce(stddev_pop(v) FILTER (v > 0), stddev_pop(v)) AS s FROM (SELECT user_id, value - 20 AS v FROM events) GROUP BY 1)
SELECT event_id, round((value - 20 - m) / (s + 1e-8), 5) + 0.0 AS z FROM events JOIN s USING (user_id) WHERE s > 1e-6""")
def w02_zscore_positive(t):
    e = t.events.select("event_id", "user_id", (F.col("value") - 20).alias("v"))
    ok = e.groupBy("user_id").agg(F.coalesce(F.stddev_pop(F.when(F.col("v") > 0, F.col("v"))), F.stddev_pop("v")).alias("s")).where("s > 1e-6").select("user_id")
    return voxels.zscore_positive(e.join(ok, "user_id", "left_semi"), "v", "user_id").select("event_id", (F.round("z", 5) + 0.0).alias("z"))


@query("""WITH m AS (SELECT l_suppkey, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1)
SELECT l_suppkey, CASE WHEN l_extendedprice > m * 1.5 THEN 3 WHEN l_extendedprice > m * 0.8 THEN 2 ELSE 0 END AS label, count(*) AS n FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1, 2""")
def w04_threshold_label(t):
    out = voxels.threshold_label(t.lineitem.select("l_suppkey", "l_extendedprice"), "l_extendedprice", "l_suppkey")
    return out.groupBy("l_suppkey", "label").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT c_custkey, CAST(c_custkey % 150 + 1 AS INT) AS size, CAST(c_custkey % 37 + 4 AS INT) AS patch FROM customer)
SELECT c_custkey, size, patch, unnest(list_distinct(list_concat(range(0, greatest(size - patch, 0) + 1, greatest(1, patch // 2)), [greatest(size - patch, 0)]))) AS start FROM s""")
def g01_tile_starts(t):
    """An axis and a patch of their own for every customer."""
    c = t.customer.select("c_custkey", (F.col("c_custkey") % 150 + 1).cast("int").alias("size"), (F.col("c_custkey") % 37 + 4).cast("int").alias("patch"))
    return c.select("c_custkey", "size", "patch", F.explode(voxels.tile_starts(F.col("size"), F.col("patch")).cast("array<long>")).alias("start"))


@query("""WITH p AS (SELECT case_id, z, y, x, c.i AS cls, avg(((x * 7 + y * 3 + z * 5 + c.i * 11 + k.i * 13 + case_id) % 17) / 16.0) AS p FROM v_vox CROSS JOIN range(4) AS c(i) CROSS JOIN range(2) AS k(i) GROUP BY 1, 2, 3, 4, 5),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, z, y, x ORDER BY p DESC, cls) AS r FROM p)
SELECT case_id, CAST(cls AS BIGINT) AS label, count(*) AS n, round(sum(p), 4) AS total FROM r WHERE r = 1 GROUP BY 1, 2""")
def g02_merge_tiles(t):
    v = t.v_vox.select("case_id", "z", "y", "x")
    p = v.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1))))
    p = p.withColumn("p", F.expr("((x * 7 + y * 3 + z * 5 + cls * 11 + k * 13 + case_id) % 17) / 16.0D"))
    return voxels.merge_tiles(p, ["case_id", "z", "y", "x"]).groupBy("case_id", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("p"), 4).alias("total"))


@query("WITH s AS (SELECT case_id, avg(intensity) AS m, stddev_pop(intensity) AS d FROM v_vox GROUP BY 1) SELECT case_id, z, count(*) AS n, round(sum(abs((intensity - m) / (d + 1e-8))), 3) AS spread FROM v_vox JOIN s USING (case_id) GROUP BY 1, 2")
def w02_zscore_plain(t):
    v = voxels.zscore_plain(t.v_vox.withColumnRenamed("z", "plane"), "intensity", "case_id")
    return v.groupBy("case_id", F.col("plane").alias("z")).agg(F.count("*").alias("n"), F.round(F.sum(F.abs("z")), 3).alias("spread"))


_OUT = {c: f"NOT ({c} BETWEEN {lo} AND {hi})" for c, (lo, hi) in BOUNDS.items()}


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {x} THEN '{c}' END" for c, x in _OUT.items()) + "], lambda v: v IS NOT NULL), ',') AS reasons FROM lineitem WHERE " + " OR ".join(_OUT.values()))
def p01_validate_ranges(t):
    return validate.validate_ranges(t.lineitem, BOUNDS)[1].select("l_orderkey", "l_linenumber", F.array_join("reasons", ",").alias("reasons"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count_if({x}) AS n_outside, count(*) AS n FROM lineitem" for c, x in _OUT.items()))
def p02_bounds_audit(t):
    return validate.bounds_audit(t.lineitem, BOUNDS)


@query("SELECT mesh_id, round(max(x) * 1000, 3) AS x, round(sum(y) * 1000, 3) AS y FROM v_node GROUP BY 1")
def p04_mm_to_um(t):
    return validate.in_micrometres(t.v_node, "mesh_id").groupBy("mesh_id").agg(F.round(F.max("x"), 3).alias("x"), F.round(F.sum("y"), 3).alias("y"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_tax, CAST(0 AS DOUBLE) AS missing FROM lineitem")
def p05_select_fields(t):
    return validate.select_fields(t.lineitem, ["l_quantity", "l_tax", "missing"], ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS result, CASE WHEN o_orderstatus <> 'F' THEN 'not completed: ' || o_orderstatus END AS error FROM orders")
def p06_completed_only(t):
    return validate.completed_only(t.orders, F.col("o_orderstatus"), "F", F.col("o_totalprice")).select("o_orderkey", "result", "error")


@query("SELECT p_partkey, round(p_retailprice / 0.3, 6) AS g, least(p_size * 20, 600) AS bcl FROM part")
def p07_conductivity(t):
    return t.part.select("p_partkey", F.round(validate.conductivity_multiplier(F.col("p_retailprice")), 6).alias("g"), F.least(F.col("p_size") * 20, F.lit(600)).alias("bcl"))


@query("SELECT l_linenumber, CASE WHEN l_quantity BETWEEN 20 AND 40 THEN 'ok' ELSE 'warn' END AS band, count(*) AS n FROM lineitem GROUP BY 1, 2")
def p10_status_band(t):
    return t.lineitem.select("l_linenumber", validate.status_band(F.col("l_quantity"), 20, 40).alias("band")).groupBy("l_linenumber", "band").agg(F.count("*").alias("n"))
