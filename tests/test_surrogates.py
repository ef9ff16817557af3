"""Surrogates on all rows: sums against NumPy, large groups, repeated rows, missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.operators import surrogate

KIND = "cohort string, output string, y double, a double, b double"


def _data(n, seed=0, noise=0.05):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, (n, 2))
    return x, np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2 + noise * rng.normal(size=n)


def _frame(spark, x, y, cohort="k"):
    return spark.createDataFrame([(cohort, "y", float(v), *map(float, r)) for r, v in zip(x, y, strict=True)], KIND)


def test_sums_with_all_points_are_the_whole_process():
    """Where every row is an inducing point the sums give the process that is fitted as a whole."""
    x, y = _data(150, noise=0.3)
    z, t, length = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std(), np.array([1.0, 1.5])
    k = surrogate._kernel(z, z, length)
    alpha, inverse, noise = surrogate.induced_process(k, k @ k, k @ t, float(t @ t), len(t))
    want, matrix = surrogate.whole_process(z, t, length, noise)
    q = surrogate._kernel(np.random.default_rng(1).uniform(-1.5, 1.5, (80, 2)), z, length)
    assert np.allclose(q @ alpha, q @ want, atol=1e-4) and np.allclose(((q @ inverse) * q).sum(1), ((q @ matrix) * q).sum(1), atol=1e-4)


def test_all_rows_of_a_large_group_teach(spark):
    """2,000 rows at 200 inducing points against NumPy's process on all 2,000: means within 3 % of the outputs' deviation,
    and nearer to the truth than what the inducing points alone would give."""
    x, y = _data(2000)
    models = surrogate.fit_surrogates(_frame(spark, x, y), ["a", "b"], chunk_rows=300)
    m = models.first()
    assert models.count() == 1 and m.n == 2000 and len(m.support) == 200
    q, truth = _data(300, seed=5, noise=0.0)
    got = surrogate.predict_surrogates(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(q)], "i int, a double, b double"), models, ["a", "b"], ["i"]).orderBy("i").toPandas()
    z, t, qz = (x - x.mean(0)) / (x.std(0) + 1e-8), (y - y.mean()) / y.std(), (q - x.mean(0)) / (x.std(0) + 1e-8)
    length = np.array(m.length)
    alpha, inverse = surrogate.whole_process(z, t, length, m.noise)
    k = surrogate._kernel(qz, z, length)
    mean, std = y.mean() + y.std() * (k @ alpha), y.std() * np.sqrt(1 + m.noise - ((k @ inverse) * k).sum(1))
    assert np.abs(got["mean"] - mean).max() < 0.03 * y.std() and np.abs(got["std"] - std).max() < 0.03 * y.std()
    some = np.array(m.support)
    at = [int(np.abs(z - s).sum(1).argmin()) for s in some]
    alone, _ = surrogate.whole_process(some, t[at], length, m.noise)
    few = y.mean() + y.std() * (surrogate._kernel(qz, some, length) @ alone)
    assert ((got["mean"] - truth) ** 2).mean() < 0.5 * ((few - truth) ** 2).mean()


def test_no_row_is_dropped(spark):
    """100,000 rows in one group, a third of them one row over again: the sums are NumPy's over all rows."""
    x, y = _data(100_000, seed=2)
    x[:33_000], y[:33_000] = x[0], y[0]
    long = spark.range(100_000).select(F.lit("k").alias("cohort"), F.lit("y").alias("output"), F.col("id"))
    rows = spark.createDataFrame([(i, float(v), *map(float, r)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id long, y double, a double, b double")
    m = surrogate.fit_surrogates(long.join(rows, "id"), ["a", "b"], inducing=50).first()
    assert m.n == 100_000 and m.mean == pytest.approx(y.mean()) and m.std == pytest.approx(y.std())
    z, t, support, length = (x - np.array(m.x_mean)) / np.array(m.x_std), (y - m.mean) / m.std, np.array(m.support), np.array(m.length)
    k = surrogate._kernel(z, support, length)
    alpha, _, noise = surrogate.induced_process(surrogate._kernel(support, support, length), k.T @ k, k.T @ t, float(t @ t), len(t))
    assert len(support) == 50 == len(np.unique(support, axis=0)) and noise == m.noise
    assert np.allclose(k[::500] @ alpha, k[::500] @ np.array(m.alpha), atol=1e-4)


def test_surrogates_of_odd_rows(spark):
    x, y = _data(40)
    rows = [("k", "y", float(v), *map(float, r)) for r, v in zip(x, y, strict=True)]
    odd = [("k", "y", None, 1.0, 1.0), ("k", "y", 1.0, None, 1.0), ("k", "y", float("nan"), 1.0, 1.0), ("few", "y", 1.0, 1.0, 1.0), ("few", "y", 2.0, 1.0, 1.0)] + [("flat", "y", 3.0, float(i), 1.0) for i in range(9)]
    models = surrogate.fit_surrogates(spark.createDataFrame(rows + odd, KIND), ["a", "b"])
    assert [(r.cohort, r.n) for r in models.collect()] == [("k", 40)]
    params = spark.createDataFrame([(1, 0.5, None, "k"), (1, 0.5, None, "k"), (2, 0.5, 0.0, "k"), (3, 0.5, 0.0, None), (4, 0.5, 0.0, "few")], "i int, a double, b double, cohort string")
    got = surrogate.predict_surrogates(params, models, ["a", "b"], ["i"]).orderBy("i").collect()
    assert [r.i for r in got] == [1, 1, 2] and len({r["mean"] for r in got}) == 1
    assert surrogate.fit_surrogates(spark.createDataFrame([], KIND), ["a", "b"]).count() == 0
