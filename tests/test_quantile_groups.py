"""Quantiles of many small groups, of large ones, and of arrays."""

import random

from pyspark.sql import functions as F

from cohortmill.operators.quantiles import exact_quantiles


def test_quantiles_of_small_and_large_groups_and_arrays(spark):
    r = random.Random(5)
    rows = [(g, r.choice([r.gauss(0, 1), 2.0])) for g, n in ((None, 30), ("a", 1), ("b", 2), ("c", 700), ("d", 1500)) for _ in range(n)] + [("a", None), ("b", float("nan")), ("e", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.0, 0.1, 0.5, 0.995, 1.0]
    got = [{x.g: (x.n, [round(v, 12) for v in x.q]) for x in exact_quantiles(d, ["g"], "x", qs, few=few).collect()} for d in (df, df.groupBy("g", F.floor("x")).agg(F.collect_list("x").alias("x"))) for few in (20_000, 600, 0)]
    assert all(x == got[0] for x in got) and {g: n for g, (n, _) in got[0].items()} == {None: 30, "a": 1, "b": 2, "c": 700, "d": 1500}
    values = sorted(x for g, x in rows if g == "c")
    assert got[0]["c"][1][2] == round((values[349] + values[350]) / 2, 12)


def test_many_small_groups_are_not_broadcast(spark):
    df = spark.range(20_000).selectExpr("id % 5000 AS g", "id * 1.0D AS x")
    plan = exact_quantiles(df, ["g"], "x", [0.1])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
