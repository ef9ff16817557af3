"""Files of many meshes."""

import pytest
from pyspark.sql import functions as F

from cohortmill.sources import files


def test_files_of_many_meshes_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("cast(id % 40 AS string) AS mesh_id", "399 - id AS at", "cast(399 - id AS string) AS value")
    files.by_mesh(rows, "at", f"file://{tmp_path}/m")
    names = [p.name.split("-")[1] for p in tmp_path.glob("m/mesh_id=*/part-*")]
    assert len(names) == 40 and len(set(names)) > 1  # a file a mesh; the part's number is its task's
    assert (next(tmp_path.glob("m/mesh_id=3/part-*"))).read_text().split() == [str(x) for x in range(36, 400, 40)]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_fibres_and_times_of_files_are_not_broadcast(spark, tmp_path):
    rows = spark.range(40).selectExpr("cast(id % 4 AS string) AS mesh_id", "id AS row", "id * 1.0D AS fx", "0.5D AS fy", "0.25D AS fz")
    f = spark.read.schema(rows.schema).parquet(_stored(rows, f"file://{tmp_path}/f"))
    owners = f.select("mesh_id", "row").unionByName(spark.createDataFrame([("none", 7)], "mesh_id string, row long"))
    own = files.owned(owners, f)
    assert "Broadcast" not in _plan(own)
    got = {(r.mesh_id, r.row): (r.fx, r.fy, r.fz) for r in own.collect()}
    assert len(got) == 41 and got["none", 7] == (1.0, 0.0, 0.0) and got["3", 39] == (39.0, 0.5, 0.25)
    (tmp_path / "a.dat").write_text("1.5\n")
    nodes = spark.createDataFrame([("a", 0), ("a", 1)], "mesh_id string, node_id long")
    t = files.read_activation(spark, f"file://{tmp_path}/a.dat", nodes)
    assert "Broadcast" not in _plan(t) and sorted(r.t_act for r in t.collect()) == [-1.0, 1.5]


def _stored(df, path: str) -> str:
    df.write.parquet(path)
    return path


def _meshes(spark):
    """40 meshes of 5 nodes, a wide mesh and one without an id."""
    n = spark.range(205).selectExpr("if(id < 200, cast(id % 40 AS string), if(id < 203, 'a b/c', null)) AS mesh_id", "id AS node_id", "id * 0.25D AS x", "-id * 1.5D AS y", "id * 1e13D AS z")
    return n, n.selectExpr("mesh_id", "node_id AS elem_id", "node_id AS n0", "node_id + 1 AS n1", "node_id + 2 AS n2", "node_id + 3 AS n3", "1 AS tag")


def test_files_of_meshes_are_listed_and_read_without_the_driver(spark, tmp_path):
    n, e = _meshes(spark)
    made = files.write_mesh(n, e, None, f"file://{tmp_path}/m")
    assert made["pts"].count() == made["elem"].count() == 42 and set(made) == {"pts", "elem"}
    assert not list(tmp_path.glob("m/*/mesh_id=*/.*"))  # neither a checksum nor a part that is not whole
    nodes = files.read_mesh_nodes(spark, f"file://{tmp_path}/m/pts", made["pts"])
    assert "Scan text" not in _plan(nodes)
    want = {(r.mesh_id, r.x): (r.y, r.z) for r in n.collect()}
    assert {(r.mesh_id, r.x): (r.y, r.z) for r in nodes.collect()} == want
    assert sorted(r.node_id for r in nodes.where("mesh_id = '7'").collect()) == [0, 1, 2, 3, 4]
    got = files.read_mesh_elements(spark, f"file://{tmp_path}/m/elem", made["elem"])
    assert got.drop("elem_id").exceptAll(e.drop("elem_id")).count() == 0 and got.count() == 205
    with pytest.raises(Exception, match="there"):
        files.write_mesh(n, None, None, f"file://{tmp_path}/m")


def test_meshes_that_lie_together_are_not_shuffled(spark, tmp_path):
    n, _ = _meshes(spark)
    lying = n.repartition(3, "mesh_id")
    files.write_mesh(lying, None, None, f"file://{tmp_path}/a", together=True)
    names = {p.name.split("-")[1] for p in tmp_path.glob("a/pts/mesh_id=*/part-*")}
    assert names <= {"00000", "00001", "00002"} and len(names) > 1  # a mesh's task is the partition in which it lay
    made = files.write_mesh(n, None, None, f"file://{tmp_path}/b", together=True)  # they don't
    assert made["pts"].count() == 42
    a, b = (files.read_mesh_nodes(spark, f"file://{tmp_path}/{x}/pts") for x in "ab")
    assert a.where("mesh_id = '7'").count() == 5 and a.exceptAll(b).count() == 0 and a.count() == b.count() == 205


def test_odd_texts_are_read_as_plain_ones(spark, tmp_path):
    for name, text in (("a", "2\n0 0.5 1\n2 3 4\n"), ("b", "\n 2 \r\n\r\n0  0.5\t1\r\n  \r\n 2 3 4"), ("c", "   \n\n")):
        (tmp_path / f"{name}.pts").write_bytes(text.encode())
    got = {(r.mesh_id, r.node_id): (r.x, r.y, r.z) for r in files.read_mesh_nodes(spark, f"file://{tmp_path}").collect()}
    assert got == {(m, k): v for m in "ab" for k, v in enumerate([(0.0, 0.5, 1.0), (2.0, 3.0, 4.0)])}


def test_decimals_are_those_of_format_string(spark):
    x = spark.range(20000).selectExpr("(rand(3) - 0.5) * pow(10, id % 14 - 6) AS x").union(spark.sql("SELECT explode(array(0.0D, 0.0000005D, 2.5e-7D, 1.0000015D, 999999999999.5D, 1e12D, 1e300D, double('NaN'), -double('Infinity'), null))"))
    off = x.select("x", files._fixed("x").alias("a"), F.format_string("%.6f", "x").alias("b")).where("a <> b or a is null")
    assert [r.b for r in off.where("not (a = '0.000000' and b = '-0.000000') or a is null").collect()] == []
