"""Operators against hand-computed answers and NumPy, on the small fixtures of FIXTURES.md."""

import hashlib
import hmac
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.functions.hashing import decimal_of_hex, hmac_sha256
from cohortmill.operators import deid, design, fibers, logs, mesh, registry, surrogate, traces, validate, voxels

SEED = "test_institutional_seed_not_for_production"
CUBE = [(x, y, z) for z in (0, 10) for y in (0, 10) for x in (0, 10)]
CUBE_TETS = [(0, 1, 2, 4), (1, 3, 2, 5), (2, 3, 5, 6), (3, 7, 5, 6), (1, 5, 4, 3), (2, 6, 4, 3)]


def _mesh(spark, points, tets, mesh_id="m"):
    n = spark.createDataFrame([(mesh_id, i, *map(float, p)) for i, p in enumerate(points)], "mesh_id string, node_id long, x double, y double, z double")
    e = spark.createDataFrame([(mesh_id, i, *t, 1) for i, t in enumerate(tets)], "mesh_id string, elem_id long, n0 long, n1 long, n2 long, n3 long, tag int")
    return n, e


def _random_mesh(seed=0, n=40, m=60):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 3)) * 10, [tuple(int(i) for i in rng.choice(n, 4, replace=False)) for _ in range(m)]


def test_hmac_and_decimal(spark):
    texts = ["PAT001", "", "Jürgen ☂", "x" * 200]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hmac_sha256(F.col("t"), SEED).alias("h"), hmac_sha256(F.col("t"), "k" * 80).alias("long")).collect()
    for r in rows:
        assert r.h == hmac.new(SEED.encode(), r.t.encode(), hashlib.sha256).hexdigest()
        assert r.long == hmac.new(b"k" * 80, r.t.encode(), hashlib.sha256).hexdigest()
    hexes = ["0" * 32, "f" * 32, "0" * 31 + "7", "00000001" + "0" * 24, *(hashlib.md5(str(i).encode()).hexdigest() for i in range(50))]
    for r in spark.createDataFrame([(h,) for h in hexes], "h string").select("h", decimal_of_hex(F.col("h")).alias("d")).collect():
        assert r.d == str(int(r.h, 16))


def test_deidentify(spark):
    T = [(1, 0, 0x10, 0x10, "PN", "Dupont^Jean"), (1, 0, 0x10, 0x20, "LO", " PAT001 "), (1, 0, 0x10, 0x30, "DA", "19800101"), (1, 0, 0x08, 0x80, "LO", "CHU de Paris"), (1, 0, 0x08, 0x60, "CS", "MR"), (1, 0, 0x20, 0x0D, "UI", "1.2.3.4"), (1, 0, 0x09, 0x10, "LO", "private"), (1, 1, 0x08, 0x90, "PN", "Dr Martin"), (1, 0, 0x18, 0x1030, "LO", "Seen by Marie Curie on 2024-01-31"), (2, 0, 0x10, 0x20, "LO", "  "), (3, 0, 0x08, 0x60, "CS", "CT")]
    tags = spark.createDataFrame(T, "file_id long, depth int, grp int, elem int, vr string, val string")
    rows, report = deid.deidentify(tags, SEED, F.sha2(F.col("file_id").cast("string"), 256))
    rep = {r.file_id: r for r in report.collect()}
    twin = hmac.new(SEED.encode(), b"PAT001", hashlib.sha256).hexdigest()
    assert rep[1].twin_id == twin and not rep[1].missing and rep[2].missing and rep[3].missing
    assert (rep[1].removed, rep[1].modified, rep[1].warnings) == (5, 2 + 1 + 1, 2)
    assert rep[2].twin_id == hmac.new(SEED.encode(), hashlib.sha256(b"2").hexdigest().encode(), hashlib.sha256).hexdigest()
    kept = {(r.grp, r.elem): r.val for r in rows.where("file_id = 1").collect()}
    uid = int(hashlib.sha256(f"{twin}:1.2.3.4".encode()).hexdigest()[:32], 16)
    assert kept[(0x20, 0x0D)] == f"2.25.{uid}" and kept[(0x10, 0x20)] == twin and (0x08, 0x80) not in kept and kept[(0x08, 0x60)] == "MR" and kept[(0x12, 0x62)] == "YES"
    assert deid.remove_tags(tags, max_depth=0).where("depth = 1").count() == 1 and deid.remove_tags(tags).where("depth = 1").count() == 0


def test_registry(spark):
    twins = spark.createDataFrame([("a", "ready", True, "2020"), ("b", "ready", False, "2020")], "twin_id string, status string, consent boolean, updated_at string")
    asked = spark.createDataFrame([("a", False, "2021"), ("c", True, "2021"), ("c", False, "2022")], "twin_id string, consent boolean, at string")
    got = {r.twin_id: (r.status, r.consent, r.updated_at) for r in registry.upsert_twins(twins, asked).collect()}
    assert got == {"a": ("ingesting", True, "2021"), "b": ("ready", False, "2020"), "c": ("ingesting", False, "2022")}
    e = spark.createDataFrame([("t", 1, "created"), ("t", 2, "simulating"), ("t", 3, "completed"), ("u", 1, "created"), ("u", 2, "completed")], "k string, at int, s string")
    got = {r.k: (r.state, r.n_illegal) for r in registry.twin_state(e, "k", F.col("s"), ["at"]).collect()}
    assert got == {"t": ("completed", 0), "u": ("completed", 1)}


def test_tet_measures(spark):
    points, tets = _random_mesh()
    n, e = _mesh(spark, points, tets)
    c = mesh.with_coordinates(e, n)
    v = points[np.array(tets)]
    det = np.array([np.linalg.det(np.array([t[1] - t[0], t[2] - t[0], t[3] - t[0]])) for t in v])
    got = c.orderBy("elem_id").select(mesh.signed_volume().alias("v"), mesh.min_dihedral().alias("d"), mesh.min_dihedral_unoriented().alias("u"), mesh.radius_ratio().alias("r")).collect()
    assert np.allclose([g.v for g in got], det / 6)
    for g, t in zip(got, v, strict=True):
        # a dihedral angle is that between the two faces' directions away from their common edge
        angles = []
        for i in range(4):
            for j in range(i + 1, 4):
                k, m = [x for x in range(4) if x not in (i, j)]
                axis = (t[j] - t[i]) / np.linalg.norm(t[j] - t[i])
                a, b = (t[x] - t[i] - axis * np.dot(t[x] - t[i], axis) for x in (k, m))
                angles.append(math.degrees(math.acos(np.clip(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b), -1, 1))))
        assert g.d == pytest.approx(min(angles), abs=1e-5)
        centre = np.linalg.solve(2 * (t[1:] - t[0]), (t[1:] ** 2).sum(1) - (t[0] ** 2).sum())
        area = sum(np.linalg.norm(np.cross(t[b] - t[a], t[c_] - t[a])) / 2 for a, b, c_ in mesh.FACES)
        vol = abs(np.linalg.det(t[1:] - t[0])) / 6
        assert g.r == pytest.approx(3 * (3 * vol / area) / np.linalg.norm(centre - t[0]), rel=1e-6)
    regular = _mesh(spark, [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)], [(0, 1, 2, 3)])
    r = mesh.with_coordinates(regular[1], regular[0]).select(mesh.radius_ratio().alias("r"), mesh.min_dihedral().alias("d")).first()
    assert r.r == pytest.approx(1) and r.d == pytest.approx(math.degrees(math.acos(1 / 3)))


def test_qc_of_fixtures(spark):
    two = _mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)], [(0, 1, 2, 3), (1, 2, 3, 4)])
    qc = mesh.mesh_qc(mesh.with_coordinates(two[1], two[0])).first()
    assert qc.n_elements == 2 and qc.n_degenerate == 0 and qc.passed
    bad = _mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], [(0, 2, 1, 3)])
    c = mesh.with_coordinates(bad[1], bad[0])
    s = {r.mesh_id: r for r in mesh.mesh_qc_signed(spark.createDataFrame([("m",), ("empty",)], "mesh_id string"), c).collect()}
    assert s["m"].n_bad == 1 and not s["m"].all_positive and s["empty"].status == "error"
    f = mesh.fix_orientation(c).first()
    assert f.flipped and (f.n1, f.n2) == (1, 2)
    big = _mesh(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0.01, 0, 0), (0, 0.01, 0), (0, 0, 0.01)], [(0, 1, 2, 3), (0, 4, 5, 6)])
    c = mesh.with_coordinates(big[1], big[0])
    assert [r.elem_id for r in c.where(mesh.filter_small_elements(c, 0.1)).collect()] == [0]


def test_faces_of_the_cube(spark):
    n, e = _mesh(spark, CUBE, CUBE_TETS)
    inc = {tuple(r.face): r.n for r in mesh.face_incidence(e).collect()}
    want = {}
    for t in CUBE_TETS:
        for f in mesh.FACES:
            k = tuple(sorted(t[i] for i in f))
            want[k] = want.get(k, 0) + 1
    assert inc == want and mesh.boundary_faces(e).count() == sum(x == 1 for x in want.values())


def _cylinder(spark, r_in=10.0, r_out=20.0, h=20.0, around=48, layers=5):
    """A thick open tube with a floor: a cavity of radius r_in above z = h / layers."""
    points, index, tets = [], {}, []

    def node(i, j, k):
        i %= around
        key = (i if j else 0, j, k)
        if key not in index:
            index[key] = len(points)
            a, r = 2 * math.pi * i / around, (0, r_in, r_out)[j]
            points.append((r * math.cos(a), r * math.sin(a), h * k / layers))
        return index[key]

    for k in range(layers):
        for i in range(around):
            for j in ((0, 1) if k == 0 else (1,)):
                p = [node(i + a, j + b, k + c) for a, b, c in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1), (1, 1, 1))]
                for t in ((0, 1, 3, 7), (0, 5, 1, 7), (0, 3, 2, 7), (0, 2, 6, 7), (0, 4, 5, 7), (0, 6, 4, 7)):
                    q = [p[x] for x in t]
                    if len(set(q)) == 4:
                        tets.append(tuple(q))
    return _mesh(spark, points, tets), points


def test_cavity_volumes_of_a_tube(spark):
    (n, e), points = _cylinder(spark)
    # a prism over 48 sides; its floor has no radial direction and is left out, so the wall gives 2 A * 16 / 3 and the
    # lid, at z = 20, A * 20 / 3
    area = 48 / 2 * 10.0**2 * math.sin(2 * math.pi / 48)
    got = mesh.cavity_volume_divergence(e, n).first()
    assert got.n_base > 0 and got.volume_ml == pytest.approx((2 * 16 + 20) * area / 3000)
    z = np.array(points)
    s = mesh.cavity_volume_slices(n, slices=4).first().volume_ml
    assert 0 < s < math.pi * 20**2 * 20 / 1000 and z[:, 2].max() == 20


def test_gradient_and_fibres(spark):
    grid = [(x, y, z) for x in range(3) for y in range(3) for z in range(3)]
    at = {p: i for i, p in enumerate(grid)}
    tets = []
    for x in range(2):
        for y in range(2):
            for z in range(2):
                for a, b in (((1, 0, 0), (1, 1, 0)), ((1, 1, 0), (0, 1, 0)), ((0, 1, 0), (0, 1, 1)), ((0, 1, 1), (0, 0, 1)), ((0, 0, 1), (1, 0, 1)), ((1, 0, 1), (1, 0, 0))):
                    tets.append((at[(x, y, z)], at[(x + a[0], y + a[1], z + a[2])], at[(x + b[0], y + b[1], z + b[2])], at[(x + 1, y + 1, z + 1)]))
    n, e = _mesh(spark, grid, tets)
    g = mesh.node_gradient(e, n.withColumn("phi", F.col("x") * 3 - F.col("z") * 4), "phi").collect()
    assert len(g) == 27 and all((r.gx, r.gy, r.gz) == pytest.approx((0.6, 0, -0.8)) for r in g)
    f = fibers.fiber_rule(spark.createDataFrame([("m", 0, 0.25, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0)], "mesh_id string, node_id long, phi_epi double, lx double, ly double, lz double, tx double, ty double, tz double")).first()
    a, b = math.radians(30), math.radians(6.25)
    fib = np.cos(a) * np.array([0, 1, 0]) + np.sin(a) * np.array([0, 0, 1])
    sheet = np.cos(b) * np.array([1, 0, 0]) + np.sin(b) * np.cross(fib, [1, 0, 0])
    assert (f.fx, f.fy, f.fz) == pytest.approx(tuple(fib)) and (f.sx, f.sy, f.sz) == pytest.approx(tuple(sheet)) and (f.nx, f.ny, f.nz) == pytest.approx(tuple(np.cross(fib, sheet)))


def test_orphans_and_defaults(spark):
    n, e = _mesh(spark, [(i, 0, 0) for i in range(10)], [(9, 2, 4, 7)])
    kept, new = mesh.drop_orphans(n, e)
    r = new.first()
    assert (r.n0, r.n1, r.n2, r.n3) == (3, 0, 1, 2) and kept.count() == 4
    c = {x.node_id: x.fx for x in mesh.carried(kept, spark.createDataFrame([("m", 4, 0.0, 1.0, 0.0)], "mesh_id string, node_id long, fx double, fy double, fz double")).collect()}
    assert c == {2: 1.0, 4: 0.0, 7: 1.0, 9: 1.0}


def test_voxels(spark):
    v = spark.createDataFrame([("c", 0, 0, i, t, p) for i, (t, p) in enumerate([(1, 1), (1, 0), (2, 2), (0, 0)])], "case_id string, z int, y int, x int, truth int, pred int")
    d = {r.label: r.dice for r in voxels.dice(v, [1, 2, 3]).collect()}
    assert d == {1: pytest.approx(2 / 3), 2: 1.0, 3: 1.0}
    s = {r.label: r.dice for r in voxels.dice(v, [3], "smooth_denominator").collect()}
    assert s == {3: 0.0}
    starts = lambda n, p: spark.range(1).select(voxels.tile_starts(n, p).alias("s")).first().s
    assert starts(100, 48) == [0, 24, 48, 52] and starts(40, 48) == [0] and starts(48, 48) == [0] and starts(96, 48) == [0, 24, 48]
    x = np.array([1.0, 2, 3, 50, 4])
    z = [r.z for r in voxels.zscore(spark.createDataFrame([("g", float(a)) for a in x], "g string, v double"), "v", "g").orderBy("v").collect()]
    y = np.clip(np.sort(x), *np.percentile(x, (0.5, 99.5)))
    assert np.allclose(z, (y - y.mean()) / y.std())
    same = voxels.zscore(spark.createDataFrame([("g", 2.0), ("g", 2.0)], "g string, v double"), "v", "g").collect()
    assert [r.z for r in same] == [0, 0]


def test_leaky_integrator_equals_rk4(spark):
    rng = np.random.default_rng(0)
    q, r, c, dt, p = rng.uniform(0, 300, 200), 1.2, 1.5, 0.01, 80.0
    want = [p]
    for x in q[1:]:
        f = lambda y: (x - y / r) / c  # noqa: E731, B023
        k1 = f(p)
        k2 = f(p + dt / 2 * k1)
        k3 = f(p + dt / 2 * k2)
        k4 = f(p + dt * k3)
        p += dt / 6 * (k1 + 2 * k2 + 2 * k3 + k4)
        want.append(p)
    d = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(q)], "s string, i int, q double")
    a, g = traces.affine(r, c, dt)
    got = [x.p for x in traces.leaky_integrator(d, "s", ["i"], "q", a, g, 80.0).orderBy("step").collect()]
    assert np.allclose(got, want, rtol=1e-12)


def test_traces(spark):
    vm = [-80, -80, 0, 10, 20, 20, 10, 0, -20, -70, -80]
    d = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(vm)] + [(1, i, -80.0) for i in range(11)], "node_id long, frame int, vm double")
    act = {r.node_id: r.t_act for r in traces.activation_time(d, dt=2.0).collect()}
    apd = {r.node_id: r.apd for r in traces.action_potential_duration(d, dt=2.0).collect()}
    assert act == {0: 4.0, 1: None} and apd == {0: 14.0, 1: None}
    m = spark.createDataFrame([("p", i, v, p, a) for i, (v, p, a) in enumerate([(120.0, 10.0, 80.0), (60.0, 110.0, 120.0), (100.0, 20.0, 90.0)])], "k string, step int, volume double, p_lv double, p_ao double")
    r = traces.slo_flags(traces.cycle_metrics(m, "k", 75.0, 10.0)).first()
    assert (r.edv, r.esv, r.sv, r.ef) == (120, 60, 60, 50) and r.co == pytest.approx(4.5) and r.dp_dt_max == pytest.approx(10000) and r.slo_passed


def test_logs(spark):
    lines = ["2024: Epoch 0", "Current learning rate: 0.01", "train_loss -0.5", "val_loss -0.25", "Pseudo dice [np.float32(0.81), np.float32(0.9), 0.95]", "Epoch time: 12.5 s", "Epoch 1", "val_loss 1", "Epoch 2", "train_loss -0.75"]
    e = logs.parse_epochs(spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "run_id string, seq int, line string")).orderBy("epoch").collect()
    assert [r.epoch for r in e] == [0, 2] and (e[0].dice_rv, e[0].dice_myo, e[0].dice_lv, e[0].lr, e[0].epoch_time_s) == (0.81, 0.9, 0.95, 0.01, 12.5)
    s = ["x [info] mechanics.fenicsx.load_step T_act_kPa=1.5 dlam=0.1 domain_err_total=0 its=4 lam=0.5 min_J=0.9", "mechanics.fenicsx.load_step_reject target=0.9 min_J=None", "mechanics.fenicsx.load_step its=3 lam=1.0 min_J=0.8", "other"]
    r = logs.load_step_summary(logs.parse_load_steps(spark.createDataFrame([("r", i, x) for i, x in enumerate(s)], "run_id string, seq int, line string"))).first()
    assert (r.n_accepted, r.n_rejected, r.iterations, r.lam, r.min_j, r.converged) == (2, 1, 7, 1.0, 0.8, True)


def test_designs(spark):
    b = {"a": (0.0, 1.0), "c": (10.0, 20.0), "d": (-1.0, 1.0)}
    for n in (1, 7, 64, 500):
        x = np.array([[r.a, r.c, r.d] for r in design.lhs_design(spark, n, b, 3).orderBy("idx").collect()])
        assert x.shape == (n, 3)
        for k, (lo, hi) in enumerate(b.values()):
            assert sorted(np.floor((x[:, k] - lo) / (hi - lo) * n + 1e-9).astype(int)) == list(range(n))
    y = np.array([[r.a, r.c, r.d] for r in design.lhs_design(spark, 500, b, 3).orderBy("idx").collect()])
    assert (x == y).all() and abs(np.corrcoef(x.T)[0, 1]) < 0.2
    p = np.random.default_rng(1).normal(size=(60, 2))
    d = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(p)], "id long, v array<double>")
    picked, least = [0], ((p - p[0]) ** 2).sum(1)
    while len(picked) < 6:
        picked.append(int(least.argmax()))
        least = np.minimum(least, ((p - p[picked[-1]]) ** 2).sum(1))
    assert [r.id for r in design.maximin_subset(d, 6, "id", "v").orderBy("pick").collect()] == picked
    assert design.maximin_subset(d.limit(3), 9, "id", "v").count() == 3
    with pytest.raises(ValueError):
        design.assign_fidelity(d, d.limit(1), "id", 1, 2)
    split = design.train_val_split(d.select("id"), "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 48, "val": 12}


def test_surrogates(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (150, 2))
    f = lambda a: np.sin(a[:, 0]) + 0.5 * a[:, 1]
    rows = [("k", "y", float(v), *map(float, r)) for r, v in zip(x, f(x), strict=True)] + [("k", "flat", 1.0, *map(float, r)) for r in x]
    long = spark.createDataFrame(rows, "cohort string, output string, y double, a double, b double")
    models = surrogate.fit_surrogates(long, ["a", "b"])
    t = rng.uniform(-1.8, 1.8, (60, 2))
    q = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(t)], "i int, a double, b double")
    got = surrogate.predict_interval(surrogate.predict_surrogates(q, models, ["a", "b"], ["i"])).orderBy("i").collect()
    y = f(t)
    assert len(got) == 60 and 1 - ((np.array([g["mean"] for g in got]) - y) ** 2).mean() / y.var() > 0.99 and all(g.ci_5 <= g["mean"] <= g.ci_95 for g in got)
    assert surrogate.predict_surrogates(q.drop("b"), models, ["a", "b"], ["i"]).count() == 60
    with pytest.raises(ValueError):
        surrogate.predict_surrogates(q.drop("b"), models, ["a", "b"], ["i"], strict=True)
    s = {r.input: r.s1 for r in surrogate.sobol_first_order(spark, 4000, {"a": (0.0, 1.0), "b": (0.0, 1.0)}, lambda d: d.withColumn("y", 2 * F.col("a") + F.col("b"))).collect()}
    assert s["a"] == pytest.approx(0.8, abs=0.06) and s["b"] == pytest.approx(0.2, abs=0.06)
    d = surrogate.predict_interval(spark.createDataFrame([(1.0, 2.0)], "mean double, std double"), draws=4000).first()
    assert d.ci_5 == pytest.approx(1 - 2 * surrogate.Z90, abs=0.25) and d.ci_95 == pytest.approx(1 + 2 * surrogate.Z90, abs=0.25)


def test_validation(spark):
    d = spark.createDataFrame([(1, 0.5, 60.0), (2, 2.0, None), (3, 0.1, 400.0)], "i int, s double, h double")
    ok, bad = validate.validate_ranges(d, {"s": (0.05, 1.0), "h": (40.0, 150.0)})
    assert [r.i for r in ok.collect()] == [1] and {r.i: r.reasons for r in bad.collect()} == {2: ["s", "h"], 3: ["h"]}
