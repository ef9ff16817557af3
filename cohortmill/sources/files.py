"""Readers and writers of mesh text files, potentials, designs, reports, training logs and manifests.

One file is one task's work and a cohort is many files; paths go to Spark's readers, listed files to workers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortmill.session import importable
from cohortmill.sources.igb import VM, FrameSource, header
from cohortmill.sources.meshfiles import contents, local_path, tasks, write_files

_NAME = r"([^/\\]+?)(?:\.[^./\\]+)?$"

#: What a text of rows with one space between words and \\n between rows doesn't hold.
_ODD = ("\r", "\t", "\v", "\f", "  ", "\n\n", "\n ", " \n")


def _texts(spark: SparkSession, path: str, listed: DataFrame | None = None) -> DataFrame:
    """(mesh_id, ls): a file's lines, blank ones left out, words one space apart; files without words are left out. mesh_id is the file's
    name or its mesh_id folder. With listed(mesh_id, path), as by_mesh() returns it, those files are read by workers, and path is not listed."""
    if listed is None:
        files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("f"), "value")
        folder = F.nullif(F.regexp_extract("f", r"mesh_id=([^/]+)/", 1), F.lit(""))
        files = files.select(F.coalesce(folder, F.regexp_extract("f", _NAME, 1)).alias("mesh_id"), "value")
    else:
        files = contents(listed)
    # a look at each line costs several times what splitting does, so that only texts that are odd somewhere get it
    text = F.btrim("value", F.lit("\n "))
    odd = reduce(or_, [F.contains(text, F.lit(x)) for x in _ODD])
    looked = F.array_join(F.transform(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(F.trim(x), r"\s+", " ")), "\n")
    rows = files.select("mesh_id", F.when(odd, looked).otherwise(text).alias("text"))
    return rows.where("text <> ''").select("mesh_id", F.split("text", "\n").alias("ls"))


def _lines(texts: DataFrame) -> DataFrame:
    """(mesh_id, at, line) in order."""
    return texts.select("mesh_id", F.posexplode("ls").alias("at", "line"))


def _checked(texts: DataFrame, what: str) -> DataFrame:
    """(mesh_id, at, line) of the lines after the header, which must count them; it is looked at once a file."""
    ok = F.trim(F.get("ls", F.lit(0))) == (F.size("ls") - 1).cast("string")
    bad = F.raise_error(F.concat(F.lit(f"{what} "), F.coalesce("mesh_id", F.lit("null")), F.lit(" doesn't hold as many rows as its header says")))
    return _lines(texts.where(F.when(ok, True).otherwise(bad.cast("boolean")))).where("at > 0")


def read_mesh_nodes(spark: SparkSession, path: str, listed: DataFrame | None = None) -> DataFrame:
    """(mesh_id, node_id, x, y, z) of .pts files: a count, then a node a line, numbered from 0."""
    p, rows = F.split("line", " "), _checked(_texts(spark, path, listed), "nodes of")
    return rows.select("mesh_id", (F.col("at") - 1).cast("long").alias("node_id"), *[p[k].cast("double").alias(c) for k, c in enumerate("xyz")])


def read_mesh_elements(spark: SparkSession, path: str, listed: DataFrame | None = None) -> DataFrame:
    """(mesh_id, elem_id, n0..n3, tag) of .elem files: a count, then `Tt n0 n1 n2 n3 tag`."""
    # told by the line, as a condition on its words would split it twice
    rows = _checked(_texts(spark, path, listed), "elements of").where((F.col("line") == "Tt") | F.startswith("line", F.lit("Tt ")))
    p = F.split("line", " ")
    return rows.select("mesh_id", (F.col("at") - 1).cast("long").alias("elem_id"), *[p[k + 1].cast("long").alias(f"n{k}") for k in range(4)], F.try_element_at(p, F.lit(6)).cast("int").alias("tag"))


def read_fibers(spark: SparkSession, path: str, owners: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """(mesh_id, row, fx, fy, fz) of .lon files, first three columns. The header is the number of vectors a line (1 or
    2) or of lines; it is not checked. With owners(mesh_id, row), rows without a fibre get (1, 0, 0)."""
    p = F.split("line", " ")
    f = _lines(_texts(spark, path, listed)).where("at > 0").select("mesh_id", (F.col("at") - 1).cast("long").alias("row"), *[p[k].cast("double").alias(c) for k, c in enumerate(("fx", "fy", "fz"))])
    return f if owners is None else owned(owners, f)


def owned(owners: DataFrame, fibers: DataFrame) -> DataFrame:
    """owners(mesh_id, row) with the fibres of read_fibers(), (1, 0, 0) for rows without one. The join's strategy is given: repeated
    vectors are so few bytes in a file that the engine would gather all of them in the driver to broadcast them."""
    return owners.select("mesh_id", "row").join(fibers.hint("merge"), ["mesh_id", "row"], "left").fillna({"fx": 1.0, "fy": 0.0, "fz": 0.0})


def read_activation(spark: SparkSession, path: str, nodes: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """nodes with t_act, the value on the line of the node's number; nodes beyond the file have -1."""
    t = _lines(_texts(spark, path, listed)).select("mesh_id", F.col("at").cast("long").alias("node_id"), F.col("line").cast("double").alias("t_act"))
    return nodes.join(t.hint("merge"), ["mesh_id", "node_id"], "left").fillna(-1.0, ["t_act"])


def read_vm_frames(spark: SparkSession, path: str, tend: float = 1.0, partition_bytes: int = 64 << 20, frames: tuple[int, int] | None = None) -> DataFrame:
    """(job_id, frame, node_id, vm, dt) of the IGB files of a folder, job_id being the file's name; with frames, those of the
    first to the last of the range. A file of any size is read by many tasks, each of which seeks to its frames; the
    header is read once. Files must be in a folder or store that workers can open (sources/igb.py); contents that Spark alone
    can reach go through vm_frames()."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", _NAME, 1).alias("job"), "path")
    files = [f"{r.job}\t{r.path}" for r in found.orderBy("path").collect()]  # a line a file: names alone, never contents
    importable(spark)
    spark.dataSource.register(FrameSource)
    first, last = frames or (0, -1)
    options = {"files": "\n".join(files), "tend": str(tend), "partition_bytes": str(partition_bytes), "first": str(first), "last": str(last)}
    return spark.read.format("igb").options(**options).load()


def vm_frames(rows: DataFrame, tend: float = 1.0) -> DataFrame:
    """(job_id, frame, node_id, vm, dt) of IGB contents (job_id, content): `x:` nodes and `t:` frames in a 1,024-byte text header, the data
    being the last frames * nodes float32. A header without them, or too little data, raises."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for job, content in zip(pdf["job_id"], pdf["content"], strict=True):
                n, frames = header(content, job)
                if len(content) < 4 * n * frames:
                    raise ValueError(f"{job} holds less than its header says")
                data = np.frombuffer(content, "<f4", offset=len(content) - 4 * n * frames).reshape(frames, n)
                dt = tend / (frames - 1) if frames > 1 else 1.0
                for a in range(0, frames, max(1, 500_000 // max(n, 1))):
                    part = data[a : a + max(1, 500_000 // max(n, 1))]
                    yield pd.DataFrame({"job_id": job, "frame": np.repeat(np.arange(a, a + len(part), dtype=np.int32), n), "node_id": np.tile(np.arange(n, dtype=np.int64), len(part)), "vm": part.ravel(), "dt": dt})

    return rows.select("job_id", "content").mapInPandas(parse, VM)


PARAMS = ("sigma_l", "sigma_t", "sigma_n", "T_max_kPa", "heart_rate_bpm", "a_kPa", "b", "R_p", "C_a", "duration_ms")
_PARAMS = ", ".join(f"{p} double" for p in PARAMS)


def read_doe_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports of design points, nested parameters flattened; absent fields are null."""
    schema = f"job_index int, job_id string, params struct<{_PARAMS.replace(' double', ': double')}>, converged boolean, duration_s double, V_ed_cavity_mL double, V_es_cavity_mL double, ef_pct double, min_jacobian double, load_fraction double, n_iterations int"
    d = spark.read.schema(schema).option("multiLine", "true").json(path)
    return d.select("*", "params.*").drop("params")


def read_design(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of parameter objects."""
    return spark.read.schema(_PARAMS).option("multiLine", "true").json(path)


TRAINING = "epoch int, train_loss double, val_loss double, lr double, dice_rv double, dice_myo double, dice_lv double, dice_mean double, minutes double"


def read_training_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING).option("header", "true").csv(path)


def discover_cases(images: DataFrame, labels: DataFrame, image_key: Column, label_key: Column) -> tuple[DataFrame, DataFrame]:
    """(pairs of case_key, image, label; images without a label), by keys made of their paths."""
    i = images.select(image_key.alias("case_key"), F.col("path").alias("image"))
    j = labels.select(label_key.alias("case_key"), F.col("path").alias("label"))
    return i.join(j, "case_key"), i.join(j, "case_key", "left_anti")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of files; their content is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")


def by_mesh(rows: DataFrame, order: str, out: str) -> DataFrame | None:
    """rows(mesh_id, .., value) as one text file a mesh in folders mesh_id=.., in order. The number of tasks is given, as by the
    few bytes of many small files the engine would leave their opening and closing to a few tasks; and each task puts its own
    files in their place, which the driver would do one by one. Nothing may read the folder before this returns.

    A folder on all machines' file system is written by workers, and the files are returned as (mesh_id, path); in any other
    store Spark writes, and None is returned: what reads then lists the folder."""
    return _put(rows.repartition(tasks(rows.sparkSession), "mesh_id"), order, out)


def _put(dealt: DataFrame, order: str, out: str) -> DataFrame | None:
    """by_mesh() of rows that lie together by mesh."""
    rows, root = dealt.sortWithinPartitions("mesh_id", order).select("mesh_id", "value"), local_path(dealt.sparkSession, out)
    if root is not None:
        return write_files(rows, root)
    rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("mesh_id").text(out)
    return None


def _fixed(c: str) -> Column:
    """A number with six decimals, zero without a sign; by decimals, in a third of format_string's time, which writes what they don't hold."""
    return F.coalesce(F.col(c).try_cast("decimal(18,6)").cast("string"), F.format_string("%.6f", c))


def write_mesh(nodes: DataFrame | None, elements: DataFrame | None, fibers: DataFrame | None, out: str, together: bool = False) -> dict[str, DataFrame | None]:
    """Text files under out/pts, out/elem and out/lon, one a mesh in folders mesh_id=..: a count (for fibres the number
    of vectors, 2), then rows with six decimals; of what is None no files. A mesh's rows are one task's work. Returns what
    by_mesh() does for each of the three. With together, rows stay in the partitions in which they are, if each mesh lies in one."""

    def put(rows: DataFrame, order: str, line: Column, head: Column | None, name: str) -> DataFrame | None:
        # a window wants each mesh in one partition: the engine shuffles what is not, whether that was said or not
        w = Window.partitionBy("mesh_id").orderBy(order)
        rows = rows if together else rows.repartition(tasks(rows.sparkSession), "mesh_id")
        n = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("string")
        rows = rows.withColumns({"__at": F.row_number().over(w), "__head": n if head is None else head})
        value = F.when(F.col("__at") == 1, F.concat("__head", F.lit("\n"), line)).otherwise(line)
        return _put(rows.select("mesh_id", order, value.alias("value")), order, f"{out}/{name}")

    listed = {}
    if nodes is not None:
        listed["pts"] = put(nodes, "node_id", F.concat_ws(" ", *map(_fixed, "xyz")), None, "pts")
    if elements is not None:
        whole = [F.coalesce(F.col(c).cast("long").cast("string"), F.lit("null")) for c in ("n0", "n1", "n2", "n3", "tag")]
        listed["elem"] = put(elements, "elem_id", F.concat_ws(" ", F.lit("Tt"), *whole), None, "elem")
    if fibers is not None:
        listed["lon"] = put(fibers, "row", F.concat_ws(" ", *map(_fixed, ("fx", "fy", "fz", "sx", "sy", "sz"))), F.lit("2"), "lon")
    return listed


def write_doe(df: DataFrame, twin_id: str, doe_id: str, out: str) -> None:
    """Result rows as JSON in folders twin_id=../doe_id=.."""
    df.withColumns({"twin_id": F.lit(twin_id), "doe_id": F.lit(doe_id)}).write.mode("append").partitionBy("twin_id", "doe_id").json(out)


def dataset_manifest(cases: DataFrame, label_col: str, channels: dict[str, str]) -> DataFrame:
    """One row: n_cases, channels, labels (distinct, sorted; labels are a short vocabulary)."""
    chan = F.create_map(*[F.lit(x) for kv in channels.items() for x in kv])
    return cases.agg(F.count("*").alias("n_cases"), F.sort_array(F.collect_set(label_col)).alias("labels")).withColumn("channels", chan)


def object_key(parts: list[tuple[Column, str]], suffix: str = "") -> Column:
    """Parts joined by /, blank or null ones by their stand-in."""
    return F.concat(F.concat_ws("/", *[F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d)) for c, d in parts]), F.lit(suffix))


def object_manifest(files: DataFrame, extension: str = r"\.(dcm|dicom)$", keep: list[str] | None = None) -> DataFrame:
    """(keep, path, size, sha256, extension_ok) of (path, content) rows."""
    return files.select(*(keep or []), "path", F.length("content").alias("size"), F.sha2("content", 256).alias("sha256"), F.lower("path").rlike(extension).alias("extension_ok"))
