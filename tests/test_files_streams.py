"""Files written and read back, and streams against their batch twins."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from cohortmill.functions.hashing import hmac_sha256
from cohortmill.operators import logs
from cohortmill.sources import files
from cohortmill.streaming import watch


def test_mesh_round_trip(spark, tmp_path):
    n = spark.createDataFrame([(m, i, i * 0.5, 1.25 * i, -1.0) for m in ("a", "b") for i in range(5)], "mesh_id string, node_id long, x double, y double, z double")
    e = spark.createDataFrame([(m, i, 0, 1, 2, 3 + i % 2, 7) for m in ("a", "b") for i in range(4)], "mesh_id string, elem_id long, n0 long, n1 long, n2 long, n3 long, tag int")
    f = spark.createDataFrame([(m, i, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0) for m in ("a", "b") for i in range(4)], "mesh_id string, row long, fx double, fy double, fz double, sx double, sy double, sz double")
    out = f"file://{tmp_path}/m"
    files.write_mesh(n, e, f, out)
    assert files.read_mesh_nodes(spark, f"{out}/pts").exceptAll(n).count() == 0 and files.read_mesh_nodes(spark, f"{out}/pts").count() == 10
    assert files.read_mesh_elements(spark, f"{out}/elem").exceptAll(e).count() == 0 and files.read_mesh_elements(spark, f"{out}/elem").count() == 8
    own = e.select("mesh_id", F.col("elem_id").alias("row")).union(spark.createDataFrame([("c", 0)], "mesh_id string, row long"))
    r = files.read_fibers(spark, f"{out}/lon", own)
    assert r.count() == 9 and r.where("mesh_id = 'c'").first().fx == 1.0
    (tmp_path / "bad.pts").write_text("3\n0 0 0\n")
    with pytest.raises(Exception, match="header"):
        files.read_mesh_nodes(spark, f"file://{tmp_path}/bad.pts").collect()
    (tmp_path / "a.dat").write_text("1.5\n2.5\n")
    t = {r.node_id: r.t_act for r in files.read_activation(spark, f"file://{tmp_path}/a.dat", n.where("mesh_id = 'a'")).collect()}
    assert t == {0: 1.5, 1: 2.5, 2: -1.0, 3: -1.0, 4: -1.0}


def test_potentials(spark, tmp_path):
    data = [float(i) for i in range(12)]
    (tmp_path / "j1.igb").write_bytes(b"x:4 y:1 z:1 t:3 type:float".ljust(1024, b"\0") + struct.pack("<12f", *data))
    r = files.read_vm_frames(spark, f"file://{tmp_path}/j1.igb", tend=10.0).orderBy("frame", "node_id").collect()
    assert [x.vm for x in r] == data and r[0].job_id == "j1" and r[0].dt == 5.0 and (r[-1].frame, r[-1].node_id) == (2, 3)
    (tmp_path / "j2.igb").write_bytes(b"nothing here")
    with pytest.raises(Exception, match="header"):
        files.read_vm_frames(spark, f"file://{tmp_path}/j2.igb").collect()


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "doe_0000.json").write_text(json.dumps({"job_index": 0, "job_id": "a", "params": {"sigma_l": 0.3, "b": 8.0}, "converged": True, "ef_pct": None, "n_iterations": 5}, indent=1))
    r = files.read_doe_reports(spark, f"file://{tmp_path}/r").first()
    assert r.sigma_l == 0.3 and r.b == 8.0 and r.ef_pct is None and r.n_iterations == 5
    (tmp_path / "d.json").write_text(json.dumps([{"sigma_l": 0.1}, {"sigma_l": 0.2, "C_a": 1.0}]))
    assert files.read_design(spark, f"file://{tmp_path}/d.json").count() == 2
    (tmp_path / "t.csv").write_text("epoch,train_loss,val_loss,lr,dice_rv,dice_myo,dice_lv,dice_mean,minutes\n1,0.5,0.4,0.01,0.8,0.9,0.95,0.88,9.5\n")
    assert files.read_training_csv(spark, f"file://{tmp_path}/t.csv").first().dice_lv == 0.95
    files.write_doe(spark.createDataFrame([(1, 2.0)], "i int, y double"), "t1", "d1", f"file://{tmp_path}/o")
    assert spark.read.json(f"file://{tmp_path}/o").first().twin_id == "t1"
    assert {"path", "length"} <= set(files.listing(spark, f"file://{tmp_path}/r").columns)


def test_epoch_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    text = []
    for run in ("r1", "r2"):
        seq = 0
        for e in range(4):
            for line in (f"Epoch {e}", f"train_loss -0.{e + 1}", f"Pseudo dice [0.8{e}, 0.9{e}, 0.95]"):
                text.append(f"{run}\t{seq}\t{line}")
                seq += 1
    for k in range(0, len(text), 5):
        (src / f"{k:04}.txt").write_text("\n".join(text[k : k + 5]) + "\n")
    lines = watch.log_lines(spark, f"file://{src}")
    q = watch.tail_epochs(lines).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start(f"file://{out}")
    q.awaitTermination(120)
    got = spark.read.parquet(f"file://{out}")
    batch = logs.parse_epochs(spark.createDataFrame([(a, int(b), c) for a, b, c in (x.split("\t") for x in text)], "run_id string, seq long, line string"))
    key = lambda d: {(r.run_id, r.epoch, r.train_loss, r.dice_myo) for r in d.collect()}
    assert key(got) == key(batch.where("epoch < 3"))  # the last epoch is still open
    assert watch.slo_watch(got.where("epoch = 0").unionByName(got), {"dice_myo": 0.9}).count() == 2


def test_ingest_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.dcm").write_bytes(b"one")
    (src / "b.dcm").write_bytes(b"one")
    run = lambda: watch.ingest_stream(spark, f"file://{src}", lambda c: hmac_sha256(c, "k"), f"file://{tmp_path}/jobs", f"file://{tmp_path}/c").awaitTermination(120)
    run()
    (src / "c.dcm").write_bytes(b"two")
    run()
    rows = spark.read.parquet(f"file://{tmp_path}/jobs").collect()
    assert len(rows) == 2 and {r.size for r in rows} == {3} and {r.status for r in rows} == {"pending"}


def test_job_states(spark):
    e = spark.createDataFrame([("a", 1, "simulating"), ("a", 2, "completed"), ("b", 1, "simulating")], "job string, at int, s string")
    p = {r.job: r.state for r in watch.job_progress(e, "job", F.col("s"), ["at"]).collect()}
    assert p == {"a": "completed", "b": "simulating"}
    j = spark.createDataFrame([("a", "simulating", 0), ("b", "completed", 0), ("c", "simulating", 900)], "job string, state string, t int")
    assert {r.job: r.state for r in watch.timed_out(j, F.lit(1000), "t").collect()} == {"a": "failed", "b": "completed", "c": "simulating"}
