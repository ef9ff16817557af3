"""Meshes written once in buckets, for the measures that read them again and again.

Nodes, and a row for each corner of each element with what else the element has, lie in files by a hash of (mesh_id,
node_id). Corners then meet nodes bucket by bucket, with no exchange of either; only what the corners have gathered is
shuffled, by element. The node is part of the key so that one large mesh is spread over all buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmill.operators.mesh import CORNERS, ELEM
from cohortmill.session import dropped, shared_dir

KEY = ("mesh_id", "node_id")


@dataclass(frozen=True)
class StoredMesh:
    """The two tables of stored_mesh(), by name and path."""

    spark: SparkSession
    names: tuple[str, str]
    paths: tuple[str, str]

    @property
    def nodes(self) -> DataFrame:
        return self.spark.table(self.names[0])

    @property
    def corners(self) -> DataFrame:
        """(mesh_id, node_id, elem_id, k, n0 .. n3, what else elements have)."""
        return self.spark.table(self.names[1])

    def with_coordinates(self, values: tuple[str, ...] = ("x", "y", "z"), nodes: DataFrame | None = None) -> DataFrame:
        """Elements with <value><k> for each corner k, as mesh.with_coordinates(). nodes: the stored nodes, or these with more
        columns; columns made by expressions, broadcast joins or joins on (mesh_id, node_id) leave the buckets as they are."""
        own = self.nodes if nodes is None else nodes
        rows = self.corners.withColumnRenamed("k", "__k")
        rest = [c for c in rows.columns if c not in (*ELEM, "node_id", "__k")]
        j = rows.join(own.select(*KEY, *values).hint("merge"), list(KEY))
        same = [F.max(c).alias(c) for c in rest]  # alike in all four rows
        return j.groupBy(*ELEM).agg(*same, *[F.max(F.when(F.col("__k") == k, F.col(v))).alias(f"{v}{k}") for k in range(4) for v in values])

    def there(self) -> bool:
        """Whether both tables still lie in the shared folder."""
        conf, path = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return all(path(p).getFileSystem(conf).exists(path(p)) for p in self.paths)

    def drop(self) -> None:
        for n in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
        dropped(self.spark, *self.paths)


def stored_mesh(nodes: DataFrame, elements: DataFrame, buckets: int | None = None) -> StoredMesh:
    """nodes and elements of any number of meshes in `buckets` files each (as many as the session's shuffle partitions, unless
    given), in the shared folder. Ids are stored as long, so that both tables hash alike; nodes without elements are kept, a
    corner whose node is missing finds no place, as in mesh.with_coordinates(). Null ids meet nothing; empty tables are stored."""
    spark = nodes.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in elements.columns if c not in (*ELEM, *CORNERS)]
    ids = {c: F.col(c).cast("long") for c in KEY}
    each = elements.select(*ELEM, *CORNERS, *rest, F.posexplode(F.array(*CORNERS)).alias("k", "node_id"))
    names, paths = [], []
    for kind, df in (("nodes", nodes), ("corners", each)):
        tag = f"mesh_{kind}_{uuid.uuid4().hex}"
        path = f"{shared_dir(spark)}/{tag}"
        # one task a bucket, so that a bucket is one file
        df.withColumns(ids).repartition(n, *KEY).write.bucketBy(n, *KEY).sortBy(*KEY).format("parquet").option("path", path).saveAsTable(tag)
        names.append(tag)
        paths.append(path)
    return StoredMesh(spark, tuple(names), tuple(paths))
