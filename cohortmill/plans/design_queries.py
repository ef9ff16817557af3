"""Queries of designs, sampling and surrogates, and of cohort set-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortmill.operators import design, surrogate, validate
from cohortmill.plans.base import query

_B = {"p1": (1.0, 50.0), "p2": (0.0, 0.1), "p3": (0.0, 0.08)}


def _r(df, digits=6):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("SELECT count(*) AS n_total, count_if(n > 25) AS n_success, count_if(n <= 25) AS n_failed, round(100.0 * count_if(n > 25) / count(*), 1) AS success_rate, count_if(n > 25) >= 50 AS slo_passed FROM v_doe")
def a23_doe_summary(t):
    return design.doe_summary(t.v_doe, F.col("n") > 25, 50)


@query(" UNION ALL ".join(f"SELECT '{c}' AS output, round(stddev_pop({c}), 6) AS std, stddev_pop({c}) <= 0.01 AS constant FROM v_doe" for c in ("p1", "p2", "p3", "out1")))
def a24_output_variance(t):
    return _r(design.output_variance_audit(t.v_doe, ["p1", "p2", "p3", "out1"]))


@query("SELECT CAST(CASE WHEN p1 < 15 THEN 0 WHEN p1 >= 35 THEN 6 ELSE floor((p1 - 15) / 4) + 1 END AS BIGINT) AS band, count(*) AS n, round(avg(out1), 3) AS mean, round(quantile_cont(out1, 0.5), 3) AS p50, round(quantile_cont(out1, 0.9), 3) AS p90, round(sum(out1), 2) AS total FROM v_doe GROUP BY 1")
def a25_run_cost_profile(t):
    out = design.run_cost_profile(t.v_doe, "p1", 15.0, 35.0, 5, "out1")
    return out.select("band", "n", *[F.round(c, 3).alias(c) for c in ("mean", "p50", "p90")], F.round("total", 2).alias("total"))


@query("SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY 1")
def k03_first_frame(t):
    return design.first_frame(t.conversations, "conv_id", "turn")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha256('42:' || doc_id)) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split FROM documents")
def k05_train_val_split(t):
    return design.train_val_split(t.documents.select("doc_id"), "doc_id")


def _draws(rows: str, key: str, draws: int, seed: int) -> str:
    """The draws of sample_with_replacement: places by the order of a keyed hash, a hash for each draw."""
    return f"""SELECT d.i AS draw, {key} FROM (SELECT i, CAST('0x' || substr(sha256('{seed + 1}:' || i), 1, 12) AS BIGINT) % (SELECT count(*) FROM ({rows}) q) AS place FROM range({draws}) AS r(i)) d
JOIN (SELECT {key}, row_number() OVER (ORDER BY sha256('{seed}:' || {key}), {key}) - 1 AS place FROM ({rows}) q) p ON p.place = d.place"""


@query(_draws("SELECT doc_id FROM documents", "doc_id", 1000, 0))
def k06_sample_with_replacement(t):
    return design.sample_with_replacement(t.documents.select("doc_id"), 1000, "doc_id")


_RARE = "SELECT doc_id FROM labels GROUP BY 1 HAVING max(toxic) = 1"


@query(f"SELECT draw, doc_id, true AS forced FROM ({_draws(_RARE, 'doc_id', 330, 1)}) a UNION ALL SELECT draw + 330, doc_id, false FROM ({_draws('SELECT DISTINCT doc_id FROM labels', 'doc_id', 170, 2)}) b")
def k07_oversample_foreground(t):
    lab = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return design.oversample_foreground(lab, F.col("toxic") == 1, 500, "doc_id")


@query("SELECT p AS param, count(*) AS n, count(*) AS strata, true AS in_bounds FROM part CROSS JOIN (VALUES ('p1'), ('p2'), ('p3')) AS q(p) GROUP BY 1")
def k08_lhs_design(t):
    """As many points as part has rows: every stratum of every parameter is hit once."""
    n = t.part.count()
    d = design.normalize_params(design.lhs_design(t.spark, n, _B, 7), _B)
    long = d.select(F.inline(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).alias("u")) for c in _B])))
    return long.groupBy("param").agg(F.count("*").alias("n"), F.countDistinct(F.floor(F.col("u") * n + 1e-9)).alias("strata"), F.every(F.col("u").between(0, 1)).alias("in_bounds"))


@query("SELECT idx, " + ", ".join(f"round(({c} - {lo}) / ({hi} - {lo}), 6) + 0.0 AS {c}" for c, (lo, hi) in _B.items()) + " FROM v_doe")
def k09_normalize_params(t):
    return _r(design.normalize_params(t.v_doe, _B).select("idx", *_B))


def _maximin(k: int) -> str:
    """CTEs m0..m<k-1>, each the next greedy pick."""
    far = "list_sum(list_transform(list_zip(e.v, p.v), lambda q: (q[1] - q[2]) ** 2))"
    ctes = ["e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)", "m0 AS (SELECT vec_id, v FROM e ORDER BY vec_id LIMIT 1)", f"d0 AS (SELECT e.vec_id, e.v, {far} AS d FROM e, m0 p WHERE e.vec_id <> p.vec_id)"]
    for i in range(1, k):
        ctes += [f"m{i} AS (SELECT vec_id, v FROM d{i - 1} ORDER BY d DESC, vec_id LIMIT 1)", f"d{i} AS (SELECT e.vec_id, e.v, least(e.d, {far}) AS d FROM d{i - 1} e, m{i} p WHERE e.vec_id <> p.vec_id)"]
    return "WITH " + ", ".join(ctes)


_PICKS = lambda k: " UNION ALL ".join(f"SELECT vec_id AS id, {i} AS pick FROM m{i}" for i in range(k))


@query(f"{_maximin(6)} {_PICKS(6)}")
def k10_maximin_subset(t):
    return design.maximin_subset(t.embeddings, 6, "vec_id", "embedding")


@query(f"{_maximin(4)}, p AS ({_PICKS(4)}) SELECT vec_id, label, CASE WHEN id IS NULL THEN 'LF' ELSE 'HF' END AS fidelity, CASE WHEN id IS NULL THEN 'coarse' ELSE 'fine' END AS mesh FROM embeddings LEFT JOIN p ON id = vec_id")
def k11_assign_fidelity(t):
    chosen = design.maximin_subset(t.embeddings, 4, "vec_id", "embedding")
    return design.assign_fidelity(t.embeddings.select("vec_id", "label"), chosen, "vec_id", 100, 4)


@query("SELECT idx, round((p1 - m1) / (s1 + 1e-8), 5) + 0.0 AS p1, round((p2 - m2) / (s2 + 1e-8), 5) + 0.0 AS p2 FROM v_doe CROSS JOIN (SELECT avg(p1) AS m1, stddev_pop(p1) AS s1, avg(p2) AS m2, stddev_pop(p2) AS s2 FROM v_doe) q")
def g03_standardize(t):
    return _r(surrogate.standardize(t.v_doe, ["p1", "p2"]).select("idx", "p1", "p2"), 5)


def _parts(t):
    """A cohort a brand of part, so that models and their rows grow in number with the tables."""
    return t.v_doe.join(t.part.select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("cohort")), "idx")


def _long(t):
    return _parts(t).select("cohort", F.lit("out1").alias("output"), F.col("out1").alias("y"), *_B)


@query("SELECT p_brand AS cohort, 'out1' AS output, count(*) AS n, least(count(*), 200) AS n_support, least(count(*), 200) AS n_alpha, round(avg(out1), 3) AS mean, round(stddev_pop(out1), 3) AS std FROM v_doe JOIN part ON p_partkey = idx GROUP BY 1 HAVING stddev_pop(out1) > 0.01 AND count(*) >= 3")
def g04_fit_surrogates(t):
    """n is how many rows taught a model: all of its cohort."""
    m = surrogate.fit_surrogates(_long(t), list(_B))
    return m.select("cohort", "output", "n", F.size("support").alias("n_support"), F.size("alpha").alias("n_alpha"), F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"))


@query()
def g05_predict_surrogates(t):
    m = surrogate.fit_surrogates(_long(t), list(_B))
    return surrogate.predict_surrogates(_parts(t), m, list(_B), ["idx"])


_SUPPORT = "(SELECT p1 / 25 AS a, p2 * 20 AS b, CASE WHEN idx % 2 = 0 THEN 0.5 ELSE -0.25 END AS alpha FROM v_doe WHERE idx <= 20)"


@query(f"SELECT idx, round(sum(alpha * exp(-((p1 / 25 - a) ** 2 + (p2 * 20 - b) ** 2) / 2)), 6) + 0.0 AS mean FROM v_doe CROSS JOIN {_SUPPORT} s GROUP BY 1")
def g05_kernel_mean(t):
    d = t.v_doe.select("idx", (F.col("p1") / 25).alias("a"), (F.col("p2") * 20).alias("b"))
    s = d.where("idx <= 20").withColumn("alpha", F.when(F.col("idx") % 2 == 0, 0.5).otherwise(-0.25))
    return _r(surrogate.kernel_mean(d, s, ["a", "b"], "idx"))


@query(f"SELECT idx, round(p1 - {surrogate.Z90} * p2, 6) AS ci_5, round(p1 + {surrogate.Z90} * p2, 6) AS ci_95 FROM v_doe")
def g06_predict_interval(t):
    return _r(surrogate.predict_interval(t.v_doe.select("idx", F.col("p1").alias("mean"), F.col("p2").alias("std"))).select("idx", "ci_5", "ci_95"))


@query("SELECT idx % 4 AS g, count(*) AS n, round(1 - avg((out1 - n * 36000) ** 2) / var_pop(out1), 6) AS r2, round(sqrt(avg((out1 - n * 36000) ** 2)), 3) AS rmse, round(avg(CASE WHEN out1 BETWEEN n * 30000 AND n * 40000 THEN 1.0 ELSE 0 END), 6) AS coverage FROM v_doe GROUP BY 1 HAVING stddev_pop(out1) > 0.01")
def g07_regression_metrics(t):
    d = t.v_doe.select((F.col("idx") % 4).alias("g"), "out1", (F.col("n") * 36000.0).alias("p"), (F.col("n") * 30000.0).alias("lo"), (F.col("n") * 40000.0).alias("hi"))
    m = surrogate.regression_metrics(d, "out1", "p", ["g"], "lo", "hi")
    return m.select("g", "n", F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("coverage", 6).alias("coverage"))


@query("WITH b AS (SELECT CAST(floor((l_quantity - 1) / 5) AS INT) AS b, count(*) AS n, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1) SELECT round((SELECT sum(n * m * m) / sum(n) - (sum(n * m) / sum(n)) ** 2 FROM b) / (SELECT var_pop(l_extendedprice) FROM lineitem), 6) AS s1")
def g08_binned_first_order(t):
    return _r(surrogate.binned_first_order(t.lineitem, "l_quantity", "l_extendedprice", 1.0, 51.0, 10))


@query("SELECT 'a' AS input, round(0.8, 1) AS s1, true AS near UNION ALL SELECT 'b', 0.2, true")
def g08_sobol_first_order(t):
    """Of y = 2 a + b, scored on as many points as lineitem has rows: the closed form's 4 / 5 and 1 / 5 within 0.02."""
    s = surrogate.sobol_first_order(t.spark, t.lineitem.count(), {"a": (0.0, 1.0), "b": (0.0, 1.0)}, lambda d: d.withColumn("y", 2 * F.col("a") + F.col("b")))
    exact = F.when(F.col("input") == "a", 0.8).otherwise(0.2)
    return s.select("input", F.round("s1", 1).alias("s1"), (F.abs(F.col("s1") - exact) < 0.02).alias("near"))


@query("SELECT p AS param, round(sum(w * v) / sum(w), 6) AS mean, round(sqrt(sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2), 6) AS std, round(sum(w) ** 2 / sum(w * w), 4) AS ess FROM (SELECT exp(-0.5 * (((n - 30) / 4.0) ** 2 + ((p1 - 25) / 3.0) ** 2)) AS w, unnest(['p1', 'p2']) AS p, unnest([p1, p2]) AS v FROM v_doe) GROUP BY 1")
def g09_posterior_weights(t):
    w = surrogate.posterior_weights(t.v_doe, {"n": (30.0, 4.0), "p1": (25.0, 3.0)})
    out = surrogate.posterior_summary(w, ["p1", "p2"])
    return out.select("param", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("ess", 4).alias("ess"))


@query("WITH w AS (SELECT p1 AS v, sum(exp(-0.5 * ((n - 30) / 4.0) ** 2)) AS w FROM v_doe GROUP BY 1), c AS (SELECT v, sum(w) OVER (ORDER BY v) AS c, sum(w) OVER () AS a FROM w) SELECT 'p1' AS param, 0.5::DOUBLE AS q, round(min(v), 6) AS value FROM c WHERE c >= 0.5 * a * (1 - 1e-12)")
def g09_weighted_quantile(t):
    return _r(surrogate.weighted_quantile(surrogate.posterior_weights(t.v_doe, {"n": (30.0, 4.0)}), "p1", 0.5))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j07_missing_truth(t):
    return validate.missing_ground_truth(t.documents.select("doc_id"), t.labels, "doc_id")


@query("""WITH r AS (SELECT d.source, l.quality, CASE WHEN l.doc_id IS NULL THEN 'no ground truth' WHEN length(d.text) < 100 THEN 'too short' END AS error FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)
SELECT source, count_if(error IS NULL) AS n_valid, round(avg(quality) FILTER (error IS NULL), 6) AS mean_quality, count_if(error IS NOT NULL) AS n_failed, max(error) AS last_error FROM r GROUP BY 1""")
def j07_error_split(t):
    """Cases without ground truth or with too little text fail, the report's means are those of the others."""
    lab = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.lit(True).alias("has"))
    error = F.when(F.col("has").isNull(), "no ground truth").when(F.length("text") < 100, "too short")
    valid, failed = validate.error_split(t.documents.join(lab, "doc_id", "left").select("source", "quality", error.alias("error")))
    v = valid.groupBy("source").agg(F.count("*").alias("n_valid"), F.round(F.avg("quality"), 6).alias("mean_quality"))
    f = failed.groupBy("source").agg(F.count("*").alias("n_failed"), F.max("error").alias("last_error"))
    return v.join(f, "source", "full_outer").fillna(0, ["n_valid", "n_failed"]).select("source", "n_valid", "mean_quality", "n_failed", "last_error")


@query("SELECT count(*) AS n_cases, array_to_string(list_sort(list_distinct(list(quality || '-' || toxic))), ',') AS labels FROM labels")
def s13_dataset_manifest(t):
    from cohortmill.sources.files import dataset_manifest

    m = dataset_manifest(t.labels.select(F.concat_ws("-", "quality", "toxic").alias("label")), "label", {"0": "intensity"})
    return m.select("n_cases", F.array_join("labels", ",").alias("labels"))


@query("""SELECT page_id, coalesce(nullif(trim(split_part(url, '/', 3)), ''), 'unknown_study') || '/' || coalesce(nullif(trim(split_part(url, '/', 4)), ''), 'unknown_series') || '/' || coalesce(nullif(trim(split_part(url, '/', 6)), ''), 'unknown_sop') || '.dcm' AS key FROM pages""")
def s14_object_key(t):
    from cohortmill.sources.files import object_key

    part = lambda n: F.split_part("url", F.lit("/"), F.lit(n))
    return t.pages.select("page_id", object_key([(part(3), "unknown_study"), (part(4), "unknown_series"), (part(6), "unknown_sop")], ".dcm").alias("key"))


@query("SELECT doc_id, octet_length(encode(text)) AS size, sha256(text) AS sha256, regexp_matches(source, '(?i)5$') AS extension_ok FROM documents")
def s15_object_manifest(t):
    from cohortmill.sources.files import object_manifest

    d = t.documents.select("doc_id", F.col("source").alias("path"), F.col("text").cast("binary").alias("content"))
    return object_manifest(d, "5$", ["doc_id"]).drop("path")


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) || '/' || coalesce(nullif(regexp_extract(url, '/([0-9]+)', 1), ''), '') AS case_key, count(*) AS n FROM pages WHERE page_id % 2 = 0 AND page_id % 3 > 0 GROUP BY 1")
def s10_discover_cases(t):
    from cohortmill.sources.files import discover_cases

    key = F.concat_ws("/", F.regexp_extract("path", "://([^/?#]*)", 1), F.regexp_extract("path", "/([0-9]+)", 1))
    img = t.pages.where("page_id % 2 = 0").select("page_id", F.col("url").alias("path"))
    lab = t.pages.where("page_id % 3 > 0").select(F.col("page_id").alias("label_id"), F.col("url").alias("path"))
    pairs, _ = discover_cases(img.withColumn("path", F.concat("path", F.lit("@"), "page_id")), lab.withColumn("path", F.concat("path", F.lit("@"), "label_id")), F.concat(key, F.regexp_extract("path", "@.*$", 0)), F.concat(key, F.regexp_extract("path", "@.*$", 0)))
    return pairs.groupBy(F.regexp_replace("case_key", "@.*$", "").alias("case_key")).agg(F.count("*").alias("n"))
