"""Meshes in buckets: the same coordinates as the plain join, without an exchange of nodes or corners."""

import re

from pyspark.sql import functions as F

from cohortmill.operators import mesh
from cohortmill.operators.meshstore import stored_mesh
from cohortmill.plans.base import Tables

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_mesh_equals_the_plain_join(spark):
    t = Tables(spark, SF)
    nodes = t.v_node.withColumn("mesh_id", F.col("mesh_id").cast("int"))  # hashed as long all the same
    m = stored_mesh(nodes, t.v_elem, buckets=3)
    got, want = m.with_coordinates(), mesh.with_coordinates(t.v_elem, t.v_node)
    assert set(got.columns) == set(want.columns)
    cols = sorted(want.columns)
    assert got.count() == want.count() > 0 and got.select(cols).exceptAll(want.select(cols)).count() == 0
    plan = _plan(got)
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and re.search(r"Exchange hashpartitioning\(mesh_id#\d+L, elem_id#\d+L", plan)
    moved = m.nodes.withColumn("dx", F.col("x") + F.col("node_id"))
    assert _plan(m.with_coordinates(("x", "dx"), moved)).count("Exchange") == 1
    files = [f for p in m.paths for f in spark.read.parquet(p).inputFiles()]
    assert len(files) <= 6  # a file a bucket and table
    assert m.there()
    m.drop()
    assert not m.there() and not any(spark.catalog.tableExists(n) for n in m.names)


def test_one_large_mesh_lies_in_all_buckets(spark):
    nodes = spark.range(4000).select(F.lit(7).cast("long").alias("mesh_id"), F.col("id").alias("node_id"), *[(F.col("id") % k * 1.0).alias(c) for c, k in zip("xyz", (11, 13, 17), strict=True)])
    elements = spark.range(3990).select(F.lit(7).cast("long").alias("mesh_id"), F.col("id").alias("elem_id"), *[(F.col("id") + k).alias(f"n{k}") for k in range(4)], F.lit("wall").alias("part"))
    m = stored_mesh(nodes, elements, buckets=4)
    sizes = [r["count"] for r in m.nodes.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.3 * 1000
    row = m.with_coordinates().where("elem_id = 100").first()
    assert (row.x0, row.x3, row.z1, row.part) == (100 % 11, 103 % 11, 101 % 17, "wall")
    m.drop()


def test_orphans_missing_nodes_nulls_and_empty_tables(spark):
    nodes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0), (1, 9, 5.0, 5.0, 5.0), (None, 3, 0.0, 0.0, 1.0)], "mesh_id int, node_id int, x double, y double, z double")
    elements = spark.createDataFrame([(1, 1, 0, 1, 2, 3), (None, 2, 0, 1, 2, 3)], "mesh_id int, elem_id int, n0 int, n1 int, n2 int, n3 int")
    m = stored_mesh(nodes, elements, buckets=2)
    (row,) = m.with_coordinates().collect()
    assert m.nodes.count() == 5 and row.elem_id == 1 and row.x1 == 1.0 and row.x3 is None
    m.drop()
    empty = stored_mesh(nodes.where("false"), elements.where("false"), buckets=2)
    assert empty.with_coordinates().count() == 0
    empty.drop()
