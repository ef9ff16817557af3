"""Connected components of an edge table by repeated hooking to the least neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.session import dropped, written


def _renamed(rows: DataFrame, parent: DataFrame, col: str) -> DataFrame:
    """rows with the node in `col` replaced by its parent, where it has one."""
    up = parent.select(F.col("node").alias(col), F.col("component").alias("__up"))
    return rows.join(up, col, "left").withColumn(col, F.coalesce("__up", col)).drop("__up")


def connected_components(edges: DataFrame) -> tuple[DataFrame, str]:
    """edges(a, b), any comparable type, either direction, repeats and loops allowed.

    Returns (node, component), component being the least node of the component, for every node with an
    edge to another node, and the path of that table. Each round every node takes the least node among
    itself and its neighbours as parent, parents are followed twice, and edges move to the parents;
    the number of nodes left with edges at least halves, so that rounds grow with the logarithm.
    Nothing is collected; a hub's edges meet only in a partial aggregate or a join that adaptive
    execution can split. Joins are with written tables, whose sizes Spark knows. No edges: an empty table.
    """
    spark = edges.sparkSession
    real = edges.where("a <> b")
    live, live_path = written(real.select("a", "b").union(real.select("b", "a")).distinct(), "edges")
    labels, labels_path = None, None
    while True:
        least, least_path = written(live.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "least")
        parent, parent_path = written(_renamed(_renamed(least, least, "component"), least, "component").select("node", "component"), "parent")
        old = [live_path, least_path]
        live, live_path = written(_renamed(_renamed(live, parent, "a"), parent, "b").where("a <> b").distinct(), "edges")
        if labels is None:
            labels, labels_path = parent, parent_path
        else:
            old += [labels_path, parent_path]
            labels, labels_path = written(_renamed(labels, parent, "component").select("node", "component"), "labels")
        dropped(spark, *old)
        if live.isEmpty():
            dropped(spark, live_path)
            return labels, labels_path
