"""Rows dealt out before they grow, and elements that meet nodes in blocks: whole results and the shape of plans."""

import random

import pytest
from pyspark.sql import functions as F

from cohortmill.operators import mesh
from cohortmill.plans.base import Tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["v_vox", "v_node", "v_elem", "v_cup"])
def test_one_small_file_grows_in_all_tasks(spark, name):
    counts = getattr(Tables(spark, SF), name).groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) > 1


def test_tasks_hold_as_much_of_many_suppliers_as_of_few(spark, tmp_path):
    """The partitions of views grow with the suppliers, not what one of them holds."""
    spark.range(2000).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    lots = Tables(spark, str(tmp_path)).v_elem.select("mesh_id").distinct().groupBy(F.spark_partition_id()).count().collect()
    assert len(lots) == 20 and sum(r["count"] for r in lots) == 2000 and max(r["count"] for r in lots) < 200


def test_elements_meet_blocks_like_a_lookup(spark):
    """Dense, sparse, negative and repeated ids, corners in one block and in several, missing nodes, nulls."""
    r = random.Random(3)
    ids = {1: range(5000), 2: [x * 700 for x in range(-40, 40)], 3: [10, 11, 1023, 1024, 1025], 4: r.sample(range(10**12), 50)}
    nodes = [(m, i, r.random(), (i % 7) / 7, None if i % 11 == 0 else 1.0) for m, x in ids.items() for i in x]
    nodes += [(1, 7, 2.0, -1.0, 0.5), (None, 1, 0.0, 0.0, 0.0), (3, None, 0.0, 0.0, 0.0)]
    elements = [(m, k, *(r.choice(list(x)) for _ in range(4)), "a") for m, x in ids.items() for k in range(60)]
    elements += [(1, 100 + k, 9 * k, 9 * k + 1, 9 * k + 2, 9 * k + 3, "b") for k in range(300)]
    elements += [(1, 900, 5, 99999, None, 1030, "c"), (1, 901, -5, None, None, 7777, "d"), (9, 902, 1, 2, 3, 4, "e"), (2, 903, None, None, None, None, "f"), (3, 904, 10, 12, 13, 14, "g"), (4, 905, 5, 6, 7, 8, "h")]
    at = {}
    for m, i, *v in nodes:
        if m is not None and i is not None:
            at[m, i] = [max((x for x in p if x is not None), default=None) for p in zip(at.get((m, i), v), v, strict=True)]
    want = {(e[0], e[1]): [at.get((e[0], n), [None] * 3)[c] for n in e[2:6] for c in range(3)] + [e[6]] for e in elements if any((e[0], n) in at for n in e[2:6])}
    n = spark.createDataFrame(nodes, "mesh_id long, node_id long, x double, y double, z double")
    e = spark.createDataFrame(elements, "mesh_id long, elem_id long, n0 long, n1 long, n2 long, n3 long, part string")
    got = mesh.with_coordinates(e, n).collect()
    assert {(x.mesh_id, x.elem_id): [x[f"{c}{k}"] for k in range(4) for c in "xyz"] + [x.part] for x in got} == want and len(got) == len(want)


def test_nothing_is_gathered_of_elements_in_one_block(spark):
    """Elements, not their four corners, are what the join of coordinates shuffles."""
    t = Tables(spark, SF)
    plan = mesh.with_coordinates(t.v_elem, t.v_node)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [mesh_id") <= 5 and "posexplode" not in plan
    one = mesh.node_blocks(t.v_node, ("x",)).where("mesh_id = 3")
    assert one.count() == 1 and one.first()["__first"] == 0


def test_flat_elements_have_no_gradient(spark):
    nodes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0), (1, 3, 0.0, 0.0, 1.0), (1, 4, 1.0, 1.0, 0.0)], "mesh_id long, node_id long, x double, y double, z double")
    elements = spark.createDataFrame([(1, 0, 0, 1, 2, 3), (1, 1, 0, 1, 2, 4)], "mesh_id long, elem_id long, n0 long, n1 long, n2 long, n3 long")
    got = {r.node_id: (r.gx, r.gy, r.gz) for r in mesh.node_gradient(elements, nodes.withColumn("phi", F.col("y")), "phi").collect()}
    assert got == {k: (0.0, 1.0, 0.0) for k in range(4)}  # node 4 is in the flat element alone


def test_faces_of_one_element_keep_their_places_across_blocks(spark):
    far = {0: 0, 1: 2000, 2: 4000, 3: 6000}
    nodes = spark.createDataFrame([(1, far[k], *map(float, p)) for k, p in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 5)])], "mesh_id long, node_id long, x double, y double, z double")
    elements = spark.createDataFrame([(1, 0, *far.values())], "mesh_id long, elem_id long, n0 long, n1 long, n2 long, n3 long")
    assert sorted(round(r.area, 3) for r in mesh.boundary_geometry(elements, nodes).collect()) == [0.5, 2.5, 2.5, 3.571]
