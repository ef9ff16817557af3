"""Surrogate models over designs: standardising, Gaussian processes in parallel, intervals, sensitivity, posterior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortmill.operators.design import lhs_design
from cohortmill.session import dropped, importable, written

Z90 = 1.6448536269514722


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with columns centred and divided by the population deviation and 1e-8, from one aggregation."""
    stat = df.agg(*[f(c).alias(f"__{k}_{c}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.join(F.broadcast(stat), how="cross")  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / (F.col(f"__s_{c}") + 1e-8) for c in cols}).drop(*stat.columns)


def _kernel(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    a, b = a / length, b / length
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.exp(-0.5 * np.maximum(d, 0.0))


MODEL = "cohort string, output string, n long, mean double, std double, x_mean array<double>, x_std array<double>, length array<double>, noise double, support array<array<double>>, alpha array<double>, inverse array<array<double>>"
_HEAD = "cohort string, output string, n long, mean double, std double, x_mean array<double>, x_std array<double>, length array<double>, noise double, support array<array<double>>, target array<double>"
NOISES = (1e-6, 1e-4, 1e-2, 1e-1)


def _lengths(z: np.ndarray, t: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Lengths and noise of the greatest marginal likelihood of t at z, from a seeded grid."""
    rng = np.random.default_rng(seed)
    tries = np.exp(rng.uniform(np.log(0.3), np.log(8.0), (40, z.shape[1])))
    tries[:6] = np.array([0.5, 1.0, 2.0, 3.0, 5.0, 8.0])[:, None]
    best = None
    for length in tries:
        k = _kernel(z, z, length)
        for noise in NOISES:
            try:
                low = np.linalg.cholesky(k + noise * np.eye(len(z)))
            except np.linalg.LinAlgError:
                continue
            half = np.linalg.solve(low, t)
            fit = -0.5 * len(t) * np.log(half @ half / len(t)) - np.log(np.diag(low)).sum()
            if best is None or fit > best[0]:
                best = (fit, length, noise)
    return best[1], best[2]


def whole_process(z: np.ndarray, t: np.ndarray, length: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """alpha and inverse of the process on its own points: mean k(x) @ alpha, variance 1 + noise - k(x) @ inverse @ k(x)."""
    inverse = np.linalg.inv(_kernel(z, z, length) + noise * np.eye(len(z)))
    return inverse @ t, inverse


def induced_process(k: np.ndarray, s: np.ndarray, b: np.ndarray, squares: float, n: int, least: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float]:
    """alpha, inverse and noise of the process that n rows teach at the inducing points: k is those points' kernel, s
    the rows' sum of k(x) k(x)', b that of k(x) t, squares that of t * t. The noise is the likeliest of all rows; with
    the rows themselves as inducing points this is whole_process(). Directions in which the points' kernel has less than
    a share `least` of its greatest value are left out: rounding of the sums would decide there."""
    value, vector = np.linalg.eigh(k)
    keep = value > least * value[-1]
    root = vector[:, keep] / np.sqrt(value[keep])
    inner, c = root.T @ s @ root, root.T @ b
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    value, c, back = np.maximum(value, 0.0), vector.T @ c, root @ vector
    fits = []
    for noise in NOISES:
        left = (squares - (c * c / (value + noise)).sum()) / noise
        fits.append(-0.5 * n * np.log(max(left, 1e-300) / n) - 0.5 * ((n - len(c)) * np.log(noise) + np.log(value + noise).sum()))
    noise = NOISES[int(np.argmax(fits))]
    return back @ (c / (value + noise)), (back * (value / (value + noise))) @ back.T, noise


def _stacked(rows) -> np.ndarray:
    return np.array([np.asarray(r, float) for r in rows])


def _heads(rows: DataFrame, stats: DataFrame, inducing: int, seed: int) -> DataFrame:
    """A model a (cohort, output) without what all its rows teach: scales, inducing points (the rows of groups of up to
    `inducing`, else the different ones least by hash), and lengths and noise of these points' likelihood."""
    order = Window.partitionBy("cohort", "output").orderBy(F.xxhash64(F.lit(seed), "x", "y"), "x", "y")
    some = rows.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= inducing).join(stats, ["cohort", "output"])

    def head(pdf: pd.DataFrame) -> pd.DataFrame:
        first, pdf = pdf.iloc[0], pdf.sort_values("__rank")
        if first["n"] <= inducing:
            pdf = pdf.loc[pdf.index.repeat(pdf["w"].astype(int))]
        else:
            pdf = pdf[~pdf["x"].map(tuple).duplicated()]
        xm, xs = np.asarray(first["x_mean"], float), np.asarray(first["x_std"], float) + 1e-8
        z, t = (_stacked(pdf["x"]) - xm) / xs, (pdf["y"].to_numpy(float) - first["mean"]) / first["std"]
        length, noise = _lengths(z, t, seed)
        return pd.DataFrame([[first["cohort"], first["output"], first["n"], first["mean"], first["std"], xm.tolist(), xs.tolist(), length.tolist(), noise, z.tolist(), t.tolist()]], columns=[c.split()[0] for c in _HEAD.split(", ")])

    return some.groupBy("cohort", "output").applyInPandas(head, _HEAD)


def _sums(rows: DataFrame, heads: DataFrame, chunk_rows: int) -> DataFrame:
    """(cohort, output, sums): what all rows of heads' groups add up to, the upper half of the sum of k(x) k(x)', then
    that of k(x) t, then that of t * t.

    Equal rows are one row with a weight w; rows meet their group's head in chunks, so that a head travels with a chunk
    and not with every row; a task adds up what it sees of a group and gives out one array a group; arrays are added
    up by place, so that neither a large group nor a large array meets in one task.
    """
    key = ["cohort", "output"]
    weighed = rows.join(heads.select(*key, "n"), key)
    chunk = F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("n") / chunk_rows)).alias("chunk")
    chunks = weighed.groupBy(*key, chunk).agg(F.collect_list(F.struct("x", "y", "w")).alias("r"))
    both = chunks.select(*key, F.col("r.x").alias("x"), F.col("r.y").alias("y"), F.col("r.w").alias("w")).join(heads.drop("target", "n", "noise"), key)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            frame = pd.DataFrame([[*k, v.tolist()] for k, v in held.items()], columns=[*key, "part"])
            held.clear()
            return frame

        for pdf in batches:
            for c in pdf.to_dict("records"):
                x = (_stacked(c["x"]) - np.asarray(c["x_mean"])) / np.asarray(c["x_std"])
                t, w, z, length = (np.asarray(c["y"]) - c["mean"]) / c["std"], np.asarray(c["w"]), _stacked(c["support"]), np.asarray(c["length"])
                total = np.zeros(len(z) * (len(z) + 1) // 2 + len(z) + 1)
                for i in range(0, len(x), 4096):
                    k = _kernel(x[i : i + 4096], z, length)
                    kw, ti = k * w[i : i + 4096, None], t[i : i + 4096]
                    total += np.concatenate([(kw.T @ k)[np.triu_indices(len(z))], kw.T @ ti, [(w[i : i + 4096] * ti * ti).sum()]])
                at = c["cohort"], c["output"]
                held[at] = held[at] + total if at in held else total
                if len(held) >= 64:
                    yield out()
        if held:
            yield out()

    parts = both.mapInPandas(add, "cohort string, output string, part array<double>")
    places = parts.select(*key, F.posexplode("part").alias("at", "v")).groupBy(*key, "at").agg(F.sum("v").alias("v"))
    return places.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda e: e["v"]).alias("sums"))


def _columns(inputs: list[str]) -> list[tuple[str, Column]]:
    return [("my", F.col("y")), *[(f"m{k}", F.col("x")[k]) for k in range(len(inputs))]]


def fit_surrogates(long: DataFrame, inputs: list[str], inducing: int = 200, least_std: float = 0.01, seed: int = 0, chunk_rows: int = 20_000) -> DataFrame:
    """A Gaussian process (constant times squared exponential, a length a parameter, and noise) for each cohort and
    output of long(cohort, output, y, inputs), many side by side; outputs whose deviation is at most least_std, and
    groups of fewer than three rows, have none. Rows with a null or NaN among inputs and y don't count; others all do.

    A group of up to `inducing` rows is fitted as a whole. Of a larger one so many rows are inducing points, and all
    its rows teach the process at these points through sums that Spark adds up (_sums); only the system of their
    size is solved in a task. Lengths are those of the inducing points' likelihood, the noise that of all rows.
    """
    importable(long.sparkSession)
    known = F.lit(True)
    for c in (*inputs, "y"):
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    key = ["cohort", "output"]
    rows = long.where(known).select(*key, F.array(*[F.col(c).cast("double") for c in inputs]).alias("x"), F.col("y").cast("double").alias("y"))
    rows, path = written(rows.groupBy(*key, "x", "y").agg(F.count("*").cast("double").alias("w")), "design")
    mean = rows.groupBy(*key).agg(F.sum("w").alias("w"), *[(F.sum(F.col("w") * v) / F.sum("w")).alias(c) for c, v in _columns(inputs)])
    mean, mean_path = written(mean, "means")
    apart = rows.join(mean.select(*key, *[F.col(c).alias(f"__{c}") for c, _ in _columns(inputs)]), key)
    square = apart.groupBy(*key).agg(*[F.sqrt(F.sum(F.col("w") * (v - F.col(f"__{c}")) * (v - F.col(f"__{c}"))) / F.sum("w")).alias(f"s_{c}") for c, v in _columns(inputs)])
    xs = [c for c, _ in _columns(inputs) if c != "my"]
    stats = mean.join(square, key).select(*key, F.col("w").cast("long").alias("n"), F.col("my").alias("mean"), F.col("s_my").alias("std"), F.array(*xs).alias("x_mean"), F.array(*[f"s_{c}" for c in xs]).alias("x_std"))
    heads, heads_path = written(_heads(rows, stats.where((F.col("std") > least_std) & (F.col("n") >= 3)), inducing, seed), "heads")
    sums, sums_path = written(_sums(rows, heads.where(F.col("n") > inducing), chunk_rows), "sums")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h in pdf.to_dict("records"):
                z, length = _stacked(h["support"]), np.asarray(h["length"])
                if h["sums"] is None:
                    alpha, inverse = whole_process(z, np.asarray(h["target"]), length, h["noise"])
                    noise = h["noise"]
                else:
                    m, sums = len(z), np.asarray(h["sums"])
                    s = np.zeros((m, m))
                    s[np.triu_indices(m)] = sums[: m * (m + 1) // 2]
                    s = np.triu(s) + np.triu(s, 1).T
                    alpha, inverse, noise = induced_process(_kernel(z, z, length), s, sums[-m - 1 : -1], sums[-1], h["n"])
                out.append([h["cohort"], h["output"], h["n"], h["mean"], h["std"], h["x_mean"], h["x_std"], h["length"], noise, z.tolist(), alpha.tolist(), inverse.tolist()])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    models, _ = written(heads.join(sums, ["cohort", "output"], "left").mapInPandas(solve, MODEL), "models")
    dropped(long.sparkSession, path, mean_path, heads_path, sums_path)
    return models


def predict_surrogates(params: DataFrame, models: DataFrame, inputs: list[str], keys: list[str], strict: bool = False, chunk_rows: int = 20_000) -> DataFrame:
    """(keys, cohort, output, mean, std): each parameter row scored by the models of its cohort, where params has a
    column cohort, else by every model. Missing and null parameters count as 0, or missing ones raise if strict.

    Rows are gathered in chunks of about `chunk_rows` of a cohort, and chunks are joined with the cohort's models, so that
    a model travels with a chunk; nothing goes through the driver. Repeated rows count as one row of a chunk.
    """
    have = [F.col(c).cast("double") if c in params.columns else F.lit(None).cast("double") for c in inputs]
    if strict and any(c not in params.columns for c in inputs):
        raise ValueError("missing parameters: " + ", ".join(c for c in inputs if c not in params.columns))
    importable(params.sparkSession)
    own = F.col("cohort") if "cohort" in params.columns else F.lit("")
    rows = params.select(own.cast("string").alias("__c"), F.struct(*keys).alias("k"), F.array(*[F.coalesce(c, F.lit(0.0)) for c in have]).alias("x"))
    rows = rows.groupBy("__c", "k", "x").agg(F.count("*").alias("times"))
    sizes, _ = written(rows.groupBy("__c").agg(F.ceil(F.count("*") / chunk_rows).alias("__n")), "sizes")
    chunk = F.pmod(F.xxhash64("k", "x"), F.col("__n")).alias("chunk")
    chunks = rows.join(sizes, "__c").groupBy("__c", chunk).agg(F.collect_list(F.struct("k", "x", "times")).alias("r"))
    of = models.withColumn("__c", F.col("cohort") if "cohort" in params.columns else F.lit(""))
    both = chunks.select("__c", F.col("r.x").alias("x"), F.col("r").alias("r")).join(of, "__c")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m in pdf.to_dict("records"):
                x, support, inverse = _stacked(m["x"]), _stacked(m["support"]), _stacked(m["inverse"])
                means, deviations = [], []
                for i in range(0, len(x), 4096):
                    k = _kernel((x[i : i + 4096] - np.asarray(m["x_mean"])) / np.asarray(m["x_std"]), support, np.asarray(m["length"]))
                    means.append(m["mean"] + m["std"] * (k @ np.asarray(m["alpha"])))
                    deviations.append(m["std"] * np.sqrt(np.maximum(1.0 + m["noise"] - ((k @ inverse) * k).sum(1), 0.0)))
                yield pd.DataFrame([[m["cohort"], m["output"], np.concatenate(means).tolist(), np.concatenate(deviations).tolist()]], columns=["cohort", "output", "mean", "std"]).assign(r=[m["r"]])

    kind = both.schema["r"].dataType.simpleString()
    scored = both.mapInPandas(score, f"cohort string, output string, mean array<double>, std array<double>, r {kind}")
    each = scored.select("cohort", "output", F.explode(F.arrays_zip("r", "mean", "std")).alias("e"))
    times = each.select("e.r.k.*", "cohort", "output", "e.mean", "e.std", F.explode(F.array_repeat(F.lit(0), F.col("e.r.times").cast("int"))).alias("__t"))
    return times.select(*keys, "cohort", "output", "mean", "std")


def kernel_mean(params: DataFrame, support: DataFrame, inputs: list[str], key: str) -> DataFrame:
    """(key, mean): sums of alpha * exp(-d^2 / 2) over a bounded table of support points (inputs, alpha), as Columns."""
    s = support.select(*[F.col(c).alias(f"__s_{c}") for c in inputs], "alpha")
    d = sum(((F.col(c) - F.col(f"__s_{c}")) * (F.col(c) - F.col(f"__s_{c}")) for c in inputs), F.lit(0.0))
    return params.join(F.broadcast(s), how="cross").groupBy(key).agg(F.sum(F.col("alpha") * F.exp(-d / 2.0)).alias("mean"))


def predict_interval(scored: DataFrame, draws: int | None = None, seed: int = 0) -> DataFrame:
    """scored with ci_5 and ci_95: mean minus and plus 1.645 deviations, or percentiles of seeded normal draws."""
    if draws is None:
        return scored.withColumns({"ci_5": F.col("mean") - Z90 * F.col("std"), "ci_95": F.col("mean") + Z90 * F.col("std")})
    rest = scored.columns
    u = lambda k: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), F.col("__d"), *rest), 11) + 0.5) / F.lit(float(1 << 53))
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(2 * F.pi() * u(2))
    x = scored.withColumn("__d", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__v", F.col("mean") + F.col("std") * normal)
    q = x.groupBy(*rest).agg(F.percentile("__v", F.array(F.lit(0.05), F.lit(0.95))).alias("__q"))
    return q.select(*rest, F.col("__q")[0].alias("ci_5"), F.col("__q")[1].alias("ci_95"))


def regression_metrics(df: DataFrame, truth: str, pred: str, by: list[str], low: str | None = None, high: str | None = None, least: float = 0.01) -> DataFrame:
    """(by, n, r2, rmse, coverage) of groups whose truth varies."""
    e = F.col(truth) - F.col(pred)
    cover = F.avg(F.col(truth).between(F.col(low), F.col(high)).cast("double")) if low else F.lit(None).cast("double")
    m = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e * e).alias("__mse"), F.var_pop(truth).alias("__var"), cover.alias("coverage")).where(F.sqrt("__var") > least)
    return m.select(*by, "n", (1 - F.col("__mse") / F.col("__var")).alias("r2"), F.sqrt("__mse").alias("rmse"), "coverage")


def sobol_first_order(spark: SparkSession, n: int, bounds: dict[str, tuple[float, float]], score, seed: int = 0) -> DataFrame:
    """(input, s1): first-order indices by two hash-seeded designs A and B and, for each input, A with B's column.

    score(df) adds a column y to rows of parameters. All designs are one table, scored in one pass.
    """
    names = list(bounds)
    a = lhs_design(spark, n, bounds, seed)
    b = lhs_design(spark, n, bounds, seed + 7919).select("idx", *[F.col(c).alias(f"__b_{c}") for c in names])
    ab = a.join(b, "idx")
    pick = [F.struct(F.lit("A").alias("m"), *[F.col(c).alias(c) for c in names]), F.struct(F.lit("B").alias("m"), *[F.col(f"__b_{c}").alias(c) for c in names])]
    pick += [F.struct(F.lit("AB_" + x).alias("m"), *[F.col(f"__b_{c}" if c == x else c).alias(c) for c in names]) for x in names]
    y = score(ab.select("idx", F.inline(F.array(*pick))))
    w = y.groupBy("idx").agg(*[F.max(F.when(F.col("m") == m, F.col("y"))).alias(m) for m in ("A", "B", *[f"AB_{x}" for x in names])])
    one = w.agg(*[F.avg(F.col("B") * (F.col(f"AB_{x}") - F.col("A"))).alias(f"v_{x}") for x in names], ((F.var_pop("A") + F.var_pop("B")) / 2).alias("v"))
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("input"), F.when(F.col("v") > 0, F.col(f"v_{x}") / F.col("v")).otherwise(0.0).alias("s1")) for x in names])))


def binned_first_order(df: DataFrame, x: str, y: str, low: float, high: float, bins: int) -> DataFrame:
    """(s1): variance of the bins' means over the variance of all, the index of one input from data at hand."""
    b = F.width_bucket(F.col(x), F.lit(low), F.lit(high), F.lit(bins))
    g = df.groupBy(b.alias("__b")).agg(F.count(y).alias("n"), F.avg(y).alias("m"), F.sum(F.col(y) * F.col(y)).alias("q"))
    t = g.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return t.select(((F.col("b") / F.col("n") - mean * mean) / (F.col("q") / F.col("n") - mean * mean)).alias("s1"))


def posterior_weights(scored: DataFrame, targets: dict[str, tuple[float, float]]) -> DataFrame:
    """scored with w: exp(-half the sum of squared standardised misses of the targets (value, sigma))."""
    miss = sum((((F.col(c) - v) / s) * ((F.col(c) - v) / s) for c, (v, s) in targets.items()), F.lit(0.0))
    return scored.withColumn("w", F.exp(-0.5 * miss))


def posterior_summary(weighted: DataFrame, params: list[str]) -> DataFrame:
    """(param, mean, std, ess): weighted moments of the parameters and the effective sample size, in one pass."""
    w = F.col("w")
    one = weighted.agg(F.sum(w).alias("sw"), F.sum(w * w).alias("sww"), *[F.sum(w * F.col(p)).alias(f"m_{p}") for p in params], *[F.sum(w * F.col(p) * F.col(p)).alias(f"q_{p}") for p in params])
    mean = lambda p: F.col(f"m_{p}") / F.col("sw")
    return one.select(F.inline(F.array(*[F.struct(F.lit(p).alias("param"), mean(p).alias("mean"), F.sqrt(F.greatest(F.col(f"q_{p}") / F.col("sw") - mean(p) * mean(p), F.lit(0.0))).alias("std"), (F.col("sw") * F.col("sw") / F.col("sww")).alias("ess")) for p in params])))


def weighted_quantile(weighted: DataFrame, param: str, q: float, bins: int = 4096) -> DataFrame:
    """(param, q, value): the least value at which the weights before and at it reach the share q.

    Weights are summed by value first; only distinct values are ordered, in one window over them by bins of range.
    """
    by = weighted.groupBy(F.col(param).alias("v")).agg(F.sum("w").alias("w"))
    ends = by.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("all"))
    x = by.join(F.broadcast(ends), how="cross")  # one row
    x = x.withColumn("__b", F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * bins)).cast("int"))
    n = x.groupBy("__b").agg(F.sum("w").alias("wb")).coalesce(1).withColumn("before", F.sum("wb").over(Window.orderBy("__b")) - F.col("wb"))
    run = x.join(F.broadcast(n.select("__b", "before")), "__b").withColumn("c", F.col("before") + F.sum("w").over(Window.partitionBy("__b").orderBy("v")))
    return run.where(F.col("c") >= q * F.col("all") * (1 - 1e-12)).agg(F.min("v").alias("value")).select(F.lit(param).alias("param"), F.lit(q).alias("q"), "value")
