"""Session helpers: a tuned builder, table loading, and tables written out to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cohortmill", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; on a cluster leave master unset."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", os.environ.get("COHORTMILL_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Spark's reader alone resolves the path, which may be in any store."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where the session names none (tests on local[*]) a temporary folder is set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="cohortmill-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def written(df: DataFrame, label: str = "t") -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and a lost
    executor costs nothing, as the files outlive it. Returns the table and its path for dropped()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables of written() that no later step reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The size of a table of written() on disk."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(hp).getLength()


def importable(spark: SparkSession) -> None:
    """Give Python workers on any machine this package: it is shipped once an application as a zip file."""
    if getattr(spark.sparkContext, "_cohortmill_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="cohortmill-"), "cohortmill.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(root)))
    spark.sparkContext.addPyFile(at)
    spark.sparkContext._cohortmill_shipped = True


def settled(df: DataFrame, label: str = "t", few: int = 100_000) -> tuple[DataFrame, str]:
    """written(), and one partition where the table has at most `few` rows: what follows on such a table needs
    no exchange. Beyond that the table keeps its files' partitions and later steps shuffle as usual."""
    out, path = written(df, label)
    return (out.coalesce(1) if out.limit(few + 1).count() <= few else out), path
