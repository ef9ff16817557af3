"""Queries of file formats and streams: views are written to the shared folder and read back, and held against the views."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortmill.operators import logs
from cohortmill.plans.base import query
from cohortmill.session import shared_dir, written
from cohortmill.sources import files
from cohortmill.streaming import watch


def _place(t) -> str:
    return f"{shared_dir(t.spark)}/files-{uuid.uuid4().hex}"


def _meshes(t, *kinds: str) -> tuple[str, dict]:
    """Meshes of every supplier as files: of nodes, elements and fibres what kinds name. The folder, and the files of each kind."""
    angle = F.col("elem_id") % 7
    fibres = t.v_elem.select("mesh_id", F.col("elem_id").alias("row"), *[x.cast("double").alias(c) for x, c in ((angle, "fx"), (-angle, "fy"), (F.lit(1), "fz"), (F.lit(0), "sx"), (F.lit(1), "sy"), (angle, "sz"))])
    out = _place(t)
    return out, files.write_mesh(*[x if k in kinds else None for k, x in (("pts", t.v_node), ("elem", t.v_elem), ("lon", fibres))], out, together=True)


@query("SELECT CAST(mesh_id AS VARCHAR) AS mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY node_id) - 1 AS node_id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM v_node")
def s01_read_mesh_nodes(t):
    """Nodes are numbered anew by their line, as the format holds no numbers."""
    out, made = _meshes(t, "pts")
    return files.read_mesh_nodes(t.spark, out + "/pts", made["pts"]).select("mesh_id", "node_id", *[F.round(c, 4).alias(c) for c in "xyz"])


@query("SELECT CAST(mesh_id AS VARCHAR) AS mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY elem_id) - 1 AS elem_id, n0, n1, n2, n3, tag FROM v_elem")
def s02_read_mesh_elements(t):
    out, made = _meshes(t, "elem")
    return files.read_mesh_elements(t.spark, out + "/elem", made["elem"])


@query("SELECT CAST(mesh_id AS VARCHAR) AS mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY elem_id) - 1 AS \"row\", CAST(elem_id % 7 AS DOUBLE) AS fx, CAST(-(elem_id % 7) AS DOUBLE) AS fy, 1.0::DOUBLE AS fz FROM v_elem UNION ALL SELECT 'none', s_suppkey, 1.0, 0.0, 0.0 FROM supplier")
def s03_read_fibers(t):
    """Every element has its fibre; rows of a mesh without a file have the stand-in."""
    out, made = _meshes(t, "lon")
    f, _ = written(files.read_fibers(t.spark, out + "/lon", listed=made["lon"]), "fibres")  # each file is opened once
    own = f.select("mesh_id", "row")
    return files.owned(own.unionByName(t.supplier.select(F.lit("none").alias("mesh_id"), F.col("s_suppkey").cast("long").alias("row"))), f)


@query("""SELECT 'pts' AS kind, CAST(mesh_id AS VARCHAR) AS mesh_id, count(*) AS n, round(sum(x + 2 * y + 3 * z), 2) AS mix FROM v_node GROUP BY 2
UNION ALL SELECT 'elem', CAST(mesh_id AS VARCHAR), count(*), CAST(sum(n0 + 2 * n1 + 3 * n2 + 4 * n3) AS DOUBLE) FROM v_elem GROUP BY 2 UNION ALL SELECT 'lon', CAST(mesh_id AS VARCHAR), count(*), CAST(sum(elem_id % 7 - 2 * (elem_id % 7) + 3) AS DOUBLE) FROM v_elem GROUP BY 2""")
def s11_write_mesh(t):
    """All three kinds of file, each read back."""
    out, made = _meshes(t, "pts", "elem", "lon")
    total = lambda df, kind, mix: df.groupBy(F.lit(kind).alias("kind"), "mesh_id").agg(F.count("*").alias("n"), F.round(F.sum(mix).cast("double"), 2).alias("mix"))
    n = total(files.read_mesh_nodes(t.spark, out + "/pts", made["pts"]), "pts", F.col("x") + 2 * F.col("y") + 3 * F.col("z"))
    e = total(files.read_mesh_elements(t.spark, out + "/elem", made["elem"]), "elem", F.col("n0") + 2 * F.col("n1") + 3 * F.col("n2") + 4 * F.col("n3"))
    f = total(files.read_fibers(t.spark, out + "/lon", listed=made["lon"]), "lon", F.col("fx") + 2 * F.col("fy") + 3 * F.col("fz"))
    return n.unionByName(e).unionByName(f)


@query("WITH n AS (SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY node_id) - 1 AS node_id FROM v_node) SELECT CAST(mesh_id AS VARCHAR) AS mesh_id, node_id, CASE WHEN node_id < 50 THEN node_id / 4.0 ELSE -1.0 END AS t_act FROM n")
def s05_read_activation(t):
    """Times of the first 50 nodes of each mesh are in files, whose lines beyond that are missing."""
    out = _place(t)
    at = F.row_number().over(Window.partitionBy("mesh_id").orderBy("node_id")) - 1
    nodes = t.v_node.select(F.col("mesh_id").cast("string").alias("mesh_id"), at.cast("long").alias("node_id"))
    rows = nodes.where("node_id < 50").select("mesh_id", "node_id", F.format_string("%.2f", F.col("node_id") / 4.0).alias("value"))
    made = files.by_mesh(rows, "node_id", out)
    return files.read_activation(t.spark, out, nodes, made)


def _json_arrays(rows, of, out: str) -> None:
    """Rows as files of JSON arrays, a thousand rows of consecutive numbers a file."""
    text = rows.select(F.floor(of / 1000).alias("k"), F.to_json(F.struct(*rows.columns)).alias("j")).groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    text.repartition("k").write.partitionBy("k").text(out)


_POINTS = "SELECT idx, p1, p2, n > 25 AS converged, CAST(n AS INT) AS n_iterations FROM v_doe"


@query(f"SELECT CAST(idx AS INT) AS job_index, round(p1, 9) AS sigma_l, round(p2, 9) AS sigma_t, CAST(NULL AS DOUBLE) AS \"T_max_kPa\", converged, n_iterations FROM ({_POINTS}) q")
def s06_read_doe_reports(t):
    out = _place(t)
    d = t.v_doe.select(F.col("idx").cast("int").alias("job_index"), F.struct(F.round("p1", 9).alias("sigma_l"), F.round("p2", 9).alias("sigma_t")).alias("params"), (F.col("n") > 25).alias("converged"), F.col("n").cast("int").alias("n_iterations"))
    _json_arrays(d, F.col("job_index"), out)
    return files.read_doe_reports(t.spark, out).select("job_index", "sigma_l", "sigma_t", "T_max_kPa", "converged", "n_iterations")


@query("SELECT round(p1, 9) AS sigma_l, round(p2, 9) AS \"C_a\", CAST(NULL AS DOUBLE) AS b FROM v_doe")
def s07_read_design(t):
    out = _place(t)
    d = t.v_doe.select("idx", F.round("p1", 9).alias("sigma_l"), F.round("p2", 9).alias("C_a"))
    _json_arrays(d, F.col("idx"), out)
    return files.read_design(t.spark, out).select("sigma_l", "C_a", "b")


@query("SELECT idx, round(out1, 2) AS y, 'twin' AS twin_id, 'doe-1' AS doe_id FROM v_doe")
def s12_write_doe(t):
    out = _place(t)
    files.write_doe(t.v_doe.select("idx", F.round("out1", 2).alias("y")), "twin", "doe-1", out)
    return t.spark.read.schema("idx long, y double, twin_id string, doe_id string").json(out)


@query("SELECT CAST(idx AS INT) AS epoch, round(p1, 6) AS train_loss, round(p2, 6) AS dice_lv FROM v_doe")
def s16_read_training_csv(t):
    out = _place(t)
    d = t.v_doe.select(F.col("idx").alias("epoch"), F.round("p1", 6).alias("train_loss"), *[F.lit(0.0).alias(c) for c in ("val_loss", "lr", "dice_rv", "dice_myo")], F.round("p2", 6).alias("dice_lv"), *[F.lit(0.0).alias(c) for c in ("dice_mean", "minutes")])
    d.write.option("header", "true").csv(out)
    return files.read_training_csv(t.spark, out).select("epoch", "train_loss", "dice_lv")


def _log_files(t) -> str:
    out = _place(t)
    t.v_log.repartition("run_id").sortWithinPartitions("run_id", "seq").select(F.format_string("%d\t%d\t%s", "run_id", "seq", "line")).write.text(out)
    return out


def _streamed(t, rows, mode="append"):
    """What a stream puts out until its input is used up."""
    out = _place(t)
    rows.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(out)


_EPOCH = "SELECT node_id AS run_id, frame AS epoch, round(-CAST('0.' || lpad(CAST((frame * 37 + node_id) % 1000 AS VARCHAR), 3, '0') AS DOUBLE), 3) AS train_loss, max(frame) OVER (PARTITION BY node_id) AS last FROM v_trace"


@query(f"SELECT CAST(run_id AS VARCHAR) AS run_id, CAST(epoch AS BIGINT) AS epoch, train_loss + 0.0 AS train_loss FROM ({_EPOCH}) q WHERE epoch < last")
def t01_tail_epochs(t):
    """The last epoch of a run stays open until a next one begins."""
    e = _streamed(t, watch.tail_epochs(watch.log_lines(t.spark, _log_files(t))))
    return e.select("run_id", "epoch", (F.round("train_loss", 3) + 0.0).alias("train_loss"))


_DICE = "SELECT node_id, frame, (800 + (frame * 7 + node_id) % 190) / 1000.0 AS rv, (800 + (frame * 11) % 190) / 1000.0 AS myo, max(frame) OVER (PARTITION BY node_id) AS last FROM v_trace"


@query(f"SELECT CAST(node_id AS VARCHAR) AS run_id, CAST(min(frame) AS BIGINT) AS epoch FROM ({_DICE}) q WHERE frame < last AND rv >= 0.85 AND myo >= 0.9 GROUP BY 1")
def t02_slo_watch(t):
    epochs = _streamed(t, watch.tail_epochs(watch.log_lines(t.spark, _log_files(t))))
    place = _place(t)
    epochs.write.parquet(place)
    stream = t.spark.readStream.schema(epochs.schema).parquet(place)
    return _streamed(t, watch.slo_watch(stream)).select("run_id", "epoch")


@query("SELECT user_id AS job, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def t03_job_progress(t):
    """The stream's table after its last micro-batch."""
    place, out = _place(t), _place(t)
    t.events.write.parquet(place)
    stream = t.spark.readStream.schema(t.events.schema).parquet(place)
    rows = watch.job_progress(stream, "user_id", F.col("event_type"), ["ts", "event_id"])

    def put(batch, k):
        batch.withColumn("__batch", F.lit(k)).write.mode("append").parquet(out)

    rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", out + "-state").trigger(availableNow=True).start().awaitTermination()
    last = t.spark.read.parquet(out).groupBy("user_id").agg(F.max(F.struct("__batch", "state", "n_events")).alias("r"))
    return last.select(F.col("user_id").alias("job"), F.col("r.n_events").alias("n_events"), F.col("r.state").alias("state"))


@query("SELECT sha256(string_agg(s_name || chr(10), '' ORDER BY s_name)) AS job_id, 'pending' AS status FROM supplier GROUP BY s_nationkey")
def t04_ingest_stream(t):
    """A file a nation arrives, and the same files once more: each content is one job."""
    place, out = _place(t), _place(t)
    rows = t.supplier.select(F.col("s_nationkey").alias("nation"), "s_name").repartition("nation").sortWithinPartitions("nation", "s_name")
    for _ in range(2):
        rows.write.mode("append").partitionBy("nation").text(place)
        watch.ingest_stream(t.spark, place, lambda sha: sha, out, out + "-state").awaitTermination()
    return t.spark.read.parquet(out).select("job_id", "status")


@query("SELECT CAST(node_id AS VARCHAR) AS job_id, frame, 0::BIGINT AS node_id, round(CAST(CAST(vm AS FLOAT) AS DOUBLE), 2) AS vm FROM v_trace")
def s04_vm_frames(t):
    """A trace a job as binary content of one node, packed in Arrow batches, then read by frames."""
    from cohortmill.plans.igb import packed

    series = t.v_trace.groupBy(F.col("node_id").cast("string").alias("job_id")).agg(F.sort_array(F.collect_list(F.struct("frame", "vm")))["vm"].alias("vm"))
    return files.vm_frames(packed(series)).select("job_id", "frame", "node_id", F.round(F.col("vm").cast("double"), 2).alias("vm"))
