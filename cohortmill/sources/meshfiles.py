"""A file a mesh, written and read by Python workers: Hadoop's local file system starts two processes for each file it makes."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.session import importable, written
from cohortmill.sources.igb import opened

_UNSAFE = re.compile(r"[\x00-\x1f\"#%'*/:=?\\\x7f{\[\]^]")


def tasks(spark: SparkSession) -> int:
    """As many as the session shuffles into, no fewer than it has cores; a number that is given is not made smaller by the few bytes of the rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def local_path(spark: SparkSession, out: str) -> str | None:
    """The path by which workers open a folder that is mounted on every machine; None in any other store. A folder that is there raises."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    store = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.getUri().getScheme() != "file":
        return None
    if store.exists(hp):
        raise FileExistsError(f"{out} is there already")
    return hp.toUri().getPath()


def folder(mesh_id: str | None) -> str:
    """The name that Spark's writers give to a partition's folder."""
    return "mesh_id=" + (_UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", mesh_id) if mesh_id else "__HIVE_DEFAULT_PARTITION__")


def _writer(root: str, run: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (mesh_id, value), a mesh's rows one after the other, to files; what comes back is (mesh_id, path) of each.

    A file takes its place by a rename when it is whole, under a name that is the same whenever its task is run again.
    """

    def closed(f, path: str) -> str:
        f.close()
        os.replace(f.name, path)
        return path

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        mesh, f, path = None, None, ""
        for batch in batches:
            runs = pc.run_end_encode(batch.column(0))
            lines = pc.fill_null(batch.column(1).cast(pa.binary()), b"")
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, *runs.run_ends.to_pylist()], pa.int32()), lines), b"\n")
            done = []
            for mesh_id, text in zip(runs.values.to_pylist(), texts.to_pylist(), strict=True):
                if f is None or mesh_id != mesh:
                    if f is not None:
                        done.append((mesh, closed(f, path)))
                    at, name = f"{root}/{folder(mesh_id)}", f"part-{context.partitionId():05d}-{run}-c{int(mesh_id is None):03d}.txt"  # no id and an empty one share a folder
                    os.makedirs(at, exist_ok=True)
                    mesh, f, path = mesh_id, open(f"{at}/.{name}.{context.taskAttemptId()}", "wb"), f"{at}/{name}"  # noqa: SIM115
                f.write(text)
                f.write(b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in done], pa.string()), pa.array([p for _, p in done], pa.string())], ["mesh_id", "path"])
        if f is not None:
            yield pa.RecordBatch.from_arrays([pa.array([mesh], pa.string()), pa.array([closed(f, path)], pa.string())], ["mesh_id", "path"])

    return write


def write_files(dealt: DataFrame, root: str) -> DataFrame:
    """The files (mesh_id, path) that dealt(mesh_id, value) became under root; each mesh's rows lie one after the other in one partition."""
    spark = dealt.sparkSession
    importable(spark)
    rows = dealt.select(F.col("mesh_id").cast("string").alias("mesh_id"), "value")
    made = rows.mapInArrow(_writer(root, uuid.uuid4().hex), "mesh_id string, path string")
    return written(made.repartition("mesh_id"), "listed")[0]  # a task's few names are no file of their own


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mesh_id, value) of files (mesh_id, path), about 4 MB a batch and one file at least."""

    def batch(ids: list, texts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], ["mesh_id", "value"])

    for listed in batches:
        ids, texts, size = [], [], 0
        for mesh_id, path in zip(listed.column(0).to_pylist(), listed.column(1).to_pylist(), strict=True):
            with opened(path) as f:
                text = f.readall()
            if ids and size + len(text) > 4 << 20:
                yield batch(ids, texts)
                ids, texts, size = [], [], 0
            ids.append(mesh_id)
            texts.append(text)
            size += len(text)
        if ids:
            yield batch(ids, texts)


def contents(listed: DataFrame) -> DataFrame:
    """(mesh_id, value) of listed(mesh_id, path): whole texts, of files that workers can open. Neither folders nor files pass the driver."""
    spark = listed.sparkSession
    importable(spark)
    rows = listed.select("mesh_id", "path").repartition(tasks(spark), "mesh_id").mapInArrow(_contents, "mesh_id string, value binary")
    return rows.select("mesh_id", F.col("value").cast("string").alias("value"))
