"""Exact quantiles, block scans and face counts against NumPy and plain loops."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.operators import mesh, traces
from cohortmill.operators.quantiles import exact_quantiles


def test_quantiles_of_uneven_groups(spark):
    """Groups of 1 to 3,000 values: even, heavy-tailed over many orders, with many ties, constant; nulls and NaN don't count."""
    rng = np.random.default_rng(0)
    groups = {
        "one": [3.0], "two": [1.0, 2.0], "same": [5.0] * 700, "even": rng.uniform(-1, 1, 3000), "tail": np.exp(40 * rng.normal(size=2000)), "ties": rng.integers(0, 7, 2500).astype(float),
        "far": np.concatenate([rng.normal(size=999), [1e300, -1e300]]), "near": 1 + 1e-12 * rng.integers(0, 500, 800), None: rng.normal(size=50),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan")), ("none", None)]
    random.Random(1).shuffle(rows)
    qs = [0.0, 0.005, 0.1, 0.5, 0.9, 1.0]
    for bins, rounds in ((512, 2), (4, 1), (3, 3)):
        got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", qs, bins, rounds).collect()}
        assert set(got) == set(groups)
        for k, vs in groups.items():
            assert got[k].n == len(vs) and got[k].q == pytest.approx(np.quantile(np.array(vs), qs).tolist(), rel=1e-9, abs=1e-12), k


def test_no_buffer_holds_a_groups_values():
    import inspect

    from cohortmill.operators import design, traces, voxels

    for m in (mesh, traces, design, voxels):
        assert not any(x in inspect.getsource(m) for x in ("F.percentile", "F.median"))


def test_quantiles_of_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([], "g string, x double"), ["g"], "x", [0.5]).count() == 0


def _folded(q, a, g, start):
    out = []
    for k, x in enumerate(q):
        out.append(start if k == 0 else a * out[-1] + g * max(x or 0.0, 0.0))
    return out


@pytest.mark.parametrize("a", [0.2, 0.97, 1.0, 1.003])
def test_block_scan_equals_the_fold(spark, a):
    """Series of many lengths with gaps, ties and negative numbers in their order; blocks of 7 steps."""
    rng = random.Random(3)
    rows, want = [], {}
    for s in (*range(12), None):
        n = rng.choice([1, 2, 7, 8, 50, 300])
        at = sorted(rng.randrange(-50, 2 * n) for _ in range(n))
        q = [rng.choice([None, -1.0, rng.uniform(0, 9)]) for _ in at]
        order = sorted(range(n), key=lambda i: (at[i], q[i] is not None, q[i] or 0.0))
        want[s] = _folded([q[i] for i in order], a, 0.3, 80.0)
        rows += [(s, at[i], q[i]) for i in range(n)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "s int, i long, q double")
    for order in (["i"], ["j", "i"]):
        got = collections.defaultdict(dict)
        for r in traces.leaky_integrator(d.withColumn("j", F.lit("x")), "s", order, "q", a, 0.3, 80.0, block=7).collect():
            got[r.s][r.step] = r.p
        assert {s: sorted(x) for s, x in got.items()} == {s: list(range(len(x))) for s, x in want.items()}
        assert all([got[s][k] for k in range(len(x))] == pytest.approx(x, rel=1e-9) for s, x in want.items())


def test_one_series_of_a_million_steps(spark):
    n, (a, g) = 1_000_000, traces.affine(1.2, 1.5, 0.4)
    flow = spark.range(n).select(F.lit(1).alias("s"), F.col("id").alias("i"), (F.col("id") % 100).cast("double").alias("q"))
    out = traces.leaky_integrator(flow, "s", ["i"], "q", a, g, 80.0)
    assert "concat" not in out._jdf.queryExecution().toString()
    p, last = 80.0, {}
    for k in range(1, n):
        p = a * p + g * (k % 100)
        if k % 99_991 == 0 or k == n - 1:
            last[k] = p
    got = {r.step: r.p for r in out.where(F.col("step").isin(list(last))).collect()}
    assert got == pytest.approx(last, rel=1e-9)
    with pytest.raises(ValueError):
        traces.leaky_integrator(flow, "s", ["i"], "q", a, g, -1.0)


def test_face_counts(spark):
    """Random elements over few nodes, so that faces stand in one, two and many elements."""
    rng = random.Random(4)
    elements = [(m, e, *rng.sample(range(7), 4), 1) for m in range(3) for e in range(12)]
    frame = spark.createDataFrame(elements, "mesh_id long, elem_id long, n0 long, n1 long, n2 long, n3 long, tag int")
    cells = collections.defaultdict(list)
    for m, e, *n, _ in elements:
        for o in range(4):
            cells[m, tuple(sorted(n[:o] + n[o + 1 :]))].append((e, *n[:o], *n[o + 1 :], n[o]))
    got = {(r.mesh_id, tuple(r.face)): (r.n, r.cells) for r in mesh.face_incidence(frame).collect()}
    assert got == {k: (len(v), sorted(x[0] for x in v)) for k, v in cells.items()} and max(n for n, _ in got.values()) > 3
    b = mesh.boundary_faces(frame)
    assert sorted((r.mesh_id, r.elem_id, r.a, r.b, r.c, r.opposite) for r in b.collect()) == sorted((k[0], *v[0]) for k, v in cells.items() if len(v) == 1)
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan


def test_draws_follow_hashes_of_keys(spark):
    """Places by the order of a keyed hash, draws by a hash of their number; null keys are never drawn; nothing of nothing."""
    import hashlib

    from cohortmill.operators import design

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    keys = [f"k{i}" for i in range(57)]
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "k string")
    order = sorted(keys, key=lambda k: h(f"5:{k}"))
    got = {r.draw: r.k for r in design.sample_with_replacement(rows, 300, "k", 5).collect()}
    assert got == {i: order[int(h(f"6:{i}")[:12], 16) % 57] for i in range(300)}
    assert design.sample_with_replacement(rows.limit(0), 300, "k", 5).count() == 0


def test_case_names_and_error_split(spark):
    from cohortmill.operators import deid, validate

    names = ["a/b/patient001_frame01.nii.gz", "patient001_frame12_gt.nii.gz", "x/mr_train_1007_image.nii", "odd", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", deid.case_name(F.col("n"), {"mr_train_": "mmwhs_"}).alias("c")).collect()
    assert {r.n: tuple(r.c) for r in rows} == {
        names[0]: ("patient001_frame01", "patient001", 1, False), names[1]: ("patient001_frame12", "patient001", 12, True), names[2]: ("mmwhs_1007_image", None, None, False),
        "odd": ("odd", None, None, False), "": ("", None, None, False), None: (None, None, None, False),
    }
    ok, bad = validate.error_split(spark.createDataFrame([(1, None), (2, "no mesh"), (3, "")], "i int, error string"))
    assert [r.i for r in ok.collect()] == [1] and ok.columns == ["i"] and sorted(r.i for r in bad.collect()) == [2, 3]
    truth = spark.createDataFrame([(1,), (1,)], "i int")
    assert sorted(r.i or 0 for r in validate.missing_ground_truth(spark.createDataFrame([(1,), (2,), (None,)], "i int"), truth, "i").collect()) == [0, 2]


def test_tiles_merge_to_the_lowest_best_class(spark):
    from cohortmill.operators import voxels

    rows = [(1, 0, 0.2), (1, 0, 0.4), (1, 2, 0.3), (1, 1, 0.1), (2, 3, 0.5), (2, 3, None), (3, 9, 1.0), (4, 1, -0.5), (5, 0, None)]
    tiles = spark.createDataFrame(rows, "v int, cls int, p double")
    out = {r.v: (r.label, round(r.p, 9)) for r in voxels.merge_tiles(tiles, ["v"]).collect()}
    assert out == {1: (0, 0.3), 2: (3, 0.5), 4: (1, -0.5)}
    assert {r.v: r.label for r in voxels.merge_tiles(tiles, ["v"], classes=(9,)).collect()} == {3: 9}
