"""Farthest points, nearest nodes by a grid, versioned tables, frames of large files, and timers of streams."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmill.operators import design, mesh, registry
from cohortmill.operators.versioned import VersionedTable
from cohortmill.sources import files
from cohortmill.streaming import watch


def _greedy(x, ids, k):
    order = np.argsort(ids)
    x, ids = x[order], np.array(ids)[order]
    picks, d = [0], ((x - x[0]) ** 2).sum(1)
    d[0] = -1
    while len(picks) < min(k, len(x)):
        i = int(np.argmax(d))
        picks.append(i)
        d = np.where(d < 0, d, np.minimum(d, ((x - x[i]) ** 2).sum(1)))
        d[i] = -1
    return [int(ids[i]) for i in picks]


def test_farthest_points_of_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = rows.select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in data], float), [r.vec_id for r in data]
    got = [r.id for r in design.maximin_subset(rows, 200, "vec_id", "embedding").orderBy("pick").collect()]
    assert got == _greedy(x, ids, 200)


def test_farthest_points_with_ties_and_few_candidates(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.uniform(0, 4, (60, 2)))  # many equal points and distances
    rows = spark.createDataFrame([(int(i) * 7 % 101, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0, 1.0]), (500, None)], "id long, v array<double>").repartition(5)
    ids = [int(i) * 7 % 101 for i in range(60)]
    for k in (1, 9, 60, 99):
        assert [r.id for r in design.maximin_subset(rows, k, "id", "v", candidates=4).orderBy("pick").collect()] == _greedy(x, ids, k)
    assert design.maximin_subset(rows.limit(0), 3, "id", "v").count() == 0


def test_nearest_of_many_probes(spark):
    """10,000 probes, some far outside, of a mesh of 20,000 nodes: as brute force says, with under 5 % of all pairs looked at."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(19_000, 3)), rng.uniform(-4, 4, (1_000, 3))]).round(2)
    q = np.concatenate([rng.uniform(-4, 4, (9_900, 3)), 60 * rng.normal(size=(100, 3))])
    nodes = spark.createDataFrame([("m", i, *map(float, r)) for i, r in enumerate(x)], "mesh_id string, node_id long, x double, y double, z double")
    probes = spark.createDataFrame([("m", i, *map(float, r)) for i, r in enumerate(q)], "mesh_id string, probe int, px double, py double, pz double")
    got = {r.probe: (r.node_id, r.distance) for r in mesh.nearest_node(probes, nodes).collect()}
    assert len(got) == len(q)
    for a in range(0, len(q), 1000):
        d = ((q[a : a + 1000, None, :] - x[None]) ** 2).sum(2)
        for j, row in enumerate(d):
            assert got[a + j][1] == pytest.approx(np.sqrt(row.min())) and row[got[a + j][0]] <= row.min() * (1 + 1e-12) + 1e-15
    meshes, cells = mesh.grid_cells(nodes)
    inside = probes.where("abs(px) <= 4 and abs(py) <= 4 and abs(pz) <= 4").join(meshes, "mesh_id")
    at = inside.select("mesh_id", "probe", *[F.floor((F.col(f"p{c}") - F.col(f"lo{c}")) / F.col("h")).alias(f"c{c}") for c in "xyz"], "across")
    assert mesh.ring_pairs(at, cells, -1, 1).count() < 0.05 * inside.count() * len(x)


def test_nearest_in_flat_and_single_meshes(spark):
    nodes = [("flat", i, float(i % 10), float(i // 10), 5.0) for i in range(100)] + [("one", 7, 1.0, 1.0, 1.0), ("same", 4, 2.0, 2.0, 2.0), ("same", 3, 2.0, 2.0, 2.0)]
    probes = [("flat", 0, 3.2, 4.1, 9.0), ("flat", 1, 0.5, 0.0, 5.0), ("one", 0, -50.0, 3.0, 0.0), ("same", 0, 2.0, 2.0, 2.0), ("none", 0, 0.0, 0.0, 0.0)]
    got = {(r.mesh_id, r.probe): (r.node_id, round(r.distance, 6)) for r in mesh.nearest_node(spark.createDataFrame(probes, "mesh_id string, probe int, px double, py double, pz double"), spark.createDataFrame(nodes, "mesh_id string, node_id long, x double, y double, z double")).collect()}
    assert got == {("flat", 0): (43, round(float(np.sqrt(0.04 + 0.01 + 16)), 6)), ("flat", 1): (0, 0.5), ("one", 0): (7, round(float(np.sqrt(51**2 + 4 + 1)), 6)), ("same", 0): (3, 0.0)}


KIND = "twin_id string, status string, consent boolean, updated_at timestamp"


def test_upserts_rewrite_touched_parts_only(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "twin_id", spark.createDataFrame([], KIND).schema, parts=32)
    assert t.read().count() == 0 and t.version() == 0
    ask = lambda ids, consent, day: spark.createDataFrame([(f"t{i}",) for i in ids], "twin_id string").select("twin_id", F.lit(consent).alias("consent"), F.lit(f"2024-01-{day:02}").cast("timestamp").alias("at"))
    assert t.upsert(ask(range(1000), True, 1), registry.upsert_twins) == 1
    before = {p: os.stat(p).st_mtime_ns for p in _files(tmp_path)}
    batch = ask([5, 6, 5000], False, 2)
    touched = {r[0] for r in batch.select(F.pmod(F.xxhash64("twin_id"), F.lit(32))).collect()}
    assert t.upsert(batch, registry.upsert_twins) == 2
    new = set(_files(tmp_path)) - set(before)
    assert {int(p.split("__part=")[1].split("/")[0]) for p in new} == touched and all(os.stat(p).st_mtime_ns == at for p, at in before.items())
    rows = {r.twin_id: r for r in t.read().collect()}
    assert len(rows) == 1001 and rows["t5"].consent and rows["t5"].updated_at.day == 2 and rows["t7"].updated_at.day == 1 and not rows["t5000"].consent
    assert t.read(1).count() == 1000  # the older version is still there
    assert t.upsert(batch.limit(0), registry.upsert_twins) == 2


def _files(folder):
    return [os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")]


def test_a_failed_batch_leaves_the_table(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "k", spark.createDataFrame([], "k long, v string").schema, parts=4)
    keep = lambda old, new: old.join(new, "k", "left_anti").unionByName(new)
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), keep)

    def breaks(old, new):
        return keep(old, new).withColumn("v", F.raise_error(F.lit("no")).cast("string"))

    with pytest.raises(Exception, match="no"):
        t.upsert(spark.createDataFrame([(1, "c")], "k long, v string"), breaks)
    assert t.version() == 1 and {r.k: r.v for r in t.read().collect()} == {1: "a", 2: "b"}
    with pytest.raises(RuntimeError):
        t._publish(1, {})


def test_frames_of_a_file_over_two_gigabytes(spark, tmp_path):
    """A sparse file of 2.4 GB is read in many parts; two of its frames hold values."""
    nodes, frames = 1_000_000, 600
    path = tmp_path / "big.igb"
    with open(path, "wb") as f:
        f.write(f"x:{nodes} y:1 z:1 t:{frames} type:float".encode().ljust(1024, b"\0"))
        f.truncate(1024 + 4 * nodes * frames)
        for at, v in ((0, 1.5), (599, 2.5)):
            f.seek(1024 + 4 * nodes * at)
            f.write(np.full(3, v, "<f4").tobytes())
    whole = files.read_vm_frames(spark, f"file://{tmp_path}", tend=599.0)
    assert path.stat().st_size > 2**31 and whole.rdd.getNumPartitions() > 30
    for frame, v in ((0, 1.5), (599, 2.5)):
        r = files.read_vm_frames(spark, f"file://{tmp_path}", tend=599.0, frames=(frame, frame)).where("vm <> 0").orderBy("node_id").collect()
        assert [(x.job_id, x.frame, x.node_id, x.vm, x.dt) for x in r] == [("big", frame, k, v, 1.0) for k in range(3)]


def test_small_files_equal_their_contents(spark, tmp_path):
    rng = np.random.default_rng(3)
    for job, n, t in (("a", 3, 7), ("b", 1, 1), ("c", 500, 4)):
        (tmp_path / f"{job}.igb").write_bytes(f"x:{n} y:1 z:1 t:{t}".encode().ljust(1024, b"\0") + rng.normal(size=n * t).astype("<f4").tobytes())
    rows = files.read_vm_frames(spark, f"file://{tmp_path}", tend=6.0, partition_bytes=40)
    want = files.vm_frames(spark.read.format("binaryFile").load(f"file://{tmp_path}").select(F.regexp_extract("path", r"(\w+)\.igb", 1).alias("job_id"), "content"), 6.0)
    assert rows.count() == want.count() == 3 * 7 + 1 + 2000 and rows.exceptAll(want).count() == 0


def _put(folder, name, rows, spark):
    spark.createDataFrame(rows, "job string, at int, s string").coalesce(1).write.mode("append").parquet(f"file://{folder}")


def test_silent_jobs_fail_by_a_timer(spark, tmp_path):
    """A job that ends ends once, one that goes on stays open, and one that falls silent comes out as failed, once."""
    src, out = tmp_path / "in", []
    _put(src, "0", [("done", 1, "simulating"), ("done", 2, "completed"), ("silent", 1, "simulating"), (None, 1, "x")], spark)
    stream = spark.readStream.schema("job string, at int, s string").parquet(f"file://{src}")
    rows = watch.job_watch(stream, "job", F.col("s"), ["at"], silence_s=6)
    q = rows.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(tuple(r) for r in b.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 90
        while len(out) < 2 and time.time() < end:
            time.sleep(0.5)
        k = 2
        while not any(r[3] for r in out) and time.time() < end:  # another job's events let micro-batches run
            _put(src, str(k), [("busy", k, "simulating")], spark)
            k += 1
            time.sleep(2)
        time.sleep(4)
    finally:
        q.stop()
    by = {j: [r[1:] for r in out if r[0] == j] for j in ("done", "silent", "busy")}
    assert by["done"] == [("completed", 2, False)] and by["silent"] == [("simulating", 1, False), ("failed", 1, True)]
    assert by["busy"] and not any(r[2] for r in by["busy"]) and [r[1] for r in by["busy"]] == sorted(r[1] for r in by["busy"]) and not any(r[0] is None for r in out)
