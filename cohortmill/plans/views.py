"""Views derived from the given tables: one SQL text that Spark and DuckDB both run. Sizes grow with the tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cohortmill.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

VIEWS["v_vox"] = r"""
SELECT s.s_suppkey AS case_id, z.i AS z, y.i AS y, x.i AS x,
 CAST(((x.i*7 + y.i*13 + z.i*29 + s.s_suppkey) % 97) * 10 AS DOUBLE) AS intensity,
 CASE WHEN (x.i-10)*(x.i-10)+(y.i-10)*(y.i-10)+4*(z.i-5)*(z.i-5) < 16 THEN 3
      WHEN (x.i-10)*(x.i-10)+(y.i-10)*(y.i-10)+4*(z.i-5)*(z.i-5) < 49 THEN 2
      WHEN (x.i-18)*(x.i-18)+(y.i-10)*(y.i-10)+4*(z.i-5)*(z.i-5) < 16 THEN 1 ELSE 0 END AS label_true,
 CASE WHEN (x.i-10-s.s_suppkey%3)*(x.i-10-s.s_suppkey%3)+(y.i-10)*(y.i-10)+4*(z.i-5)*(z.i-5) < 16 THEN 3
      WHEN (x.i-10-s.s_suppkey%3)*(x.i-10-s.s_suppkey%3)+(y.i-10)*(y.i-10)+4*(z.i-5)*(z.i-5) < 49 THEN 2
      WHEN (x.i-18)*(x.i-18)+(y.i-10)*(y.i-10)+4*(z.i-5)*(z.i-5) < 16 THEN 1 ELSE 0 END AS label_pred
FROM supplier s CROSS JOIN range(12) AS z(i) CROSS JOIN range(24) AS y(i) CROSS JOIN range(24) AS x(i)
"""

VIEWS["v_node"] = r"""
SELECT s.s_suppkey AS mesh_id, x.i + 9*y.i + 81*z.i AS node_id,
 CAST(2.0 AS DOUBLE)*x.i + CAST(0.05 AS DOUBLE)*((7*x.i+13*y.i+29*z.i+s.s_suppkey)%11) AS x,
 CAST(2.0 AS DOUBLE)*y.i + CAST(0.05 AS DOUBLE)*((5*x.i+11*y.i+17*z.i+s.s_suppkey)%7) AS y,
 CAST(2.0 AS DOUBLE)*z.i + CAST(0.05 AS DOUBLE)*((3*x.i+19*y.i+23*z.i+s.s_suppkey)%5) AS z
FROM supplier s CROSS JOIN range(9) AS z(i) CROSS JOIN range(9) AS y(i) CROSS JOIN range(9) AS x(i)
WHERE x.i <= 4+s.s_suppkey%5 AND y.i <= 4+s.s_suppkey%5 AND z.i <= 4+s.s_suppkey%5
"""

VIEWS["v_elem"] = r"""
SELECT mesh_id, elem_id, n0, CASE WHEN elem_id%17=0 THEN n2 ELSE n1 END AS n1,
 CASE WHEN elem_id%17=0 THEN n1 ELSE n2 END AS n2, n3, 1 AS tag FROM (
 SELECT s.s_suppkey AS mesh_id, 6*(x.i+8*y.i+64*z.i)+p.k AS elem_id,
 x.i+9*y.i+81*z.i AS n0, x.i+9*y.i+81*z.i+p.a AS n1, x.i+9*y.i+81*z.i+p.b AS n2, x.i+9*y.i+81*z.i+91 AS n3
 FROM supplier s CROSS JOIN range(8) AS z(i) CROSS JOIN range(8) AS y(i) CROSS JOIN range(8) AS x(i)
 CROSS JOIN (VALUES (0,1,10),(1,82,1),(2,9,90),(3,10,9),(4,81,82),(5,90,81)) AS p(k,a,b)
 WHERE x.i < 4+s.s_suppkey%5 AND y.i < 4+s.s_suppkey%5 AND z.i < 4+s.s_suppkey%5) q
"""

VIEWS["v_cup"] = r"""
SELECT e.* FROM v_elem e
WHERE (CAST(floor(e.elem_id/6) AS BIGINT))%8 IN (0, 3+e.mesh_id%5)
   OR (CAST(floor(floor(e.elem_id/6)/8) AS BIGINT))%8 IN (0, 3+e.mesh_id%5)
   OR CAST(floor(floor(e.elem_id/6)/64) AS BIGINT) = 0
"""

VIEWS["v_trace"] = r"""
SELECT user_id AS node_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS frame, value AS vm FROM events
"""

VIEWS["v_doe"] = r"""
SELECT l_partkey AS idx, avg(l_quantity) AS p1, avg(l_discount) AS p2, avg(l_tax) AS p3,
 sum(l_extendedprice*(1-l_discount)) AS out1, count(*) AS n FROM lineitem GROUP BY l_partkey
"""

VIEWS["v_tags"] = r"""
SELECT c_custkey AS file_id, 0 AS depth, 16 AS grp, 16 AS elem, 'PN' AS vr, c_name AS val FROM customer
UNION ALL SELECT c_custkey, 0, 16, 32, 'LO', CASE WHEN c_custkey%13=0 THEN '  ' ELSE concat(' PAT', CAST(c_custkey AS STRING)) END FROM customer
UNION ALL SELECT c_custkey, 0, 8, 128, 'LO', c_mktsegment FROM customer
UNION ALL SELECT c_custkey, 0, 8, 96, 'CS', 'MR' FROM customer
UNION ALL SELECT c_custkey, 0, 32, 13, 'UI', concat('1.2.3.', CAST(c_custkey AS STRING)) FROM customer
UNION ALL SELECT c_custkey, 0, 9, 16, 'LO', 'private' FROM customer WHERE c_custkey%2=0
UNION ALL SELECT c_custkey, 1, 8, 144, 'PN', 'Jean Dupont' FROM customer WHERE c_custkey%3=0
UNION ALL SELECT c_custkey, 0, 24, 4144, 'LO', 'Protocol of 2024-01-31' FROM customer WHERE c_custkey%5=0
"""

VIEWS["v_log"] = r"""
SELECT node_id AS run_id, 3*frame + k AS seq, CASE k WHEN 0 THEN concat('Epoch ', CAST(frame AS STRING))
 WHEN 1 THEN concat('train_loss -0.', lpad(CAST((frame*37+node_id)%1000 AS STRING),3,'0'))
 ELSE concat('Pseudo dice [np.float32(0.', lpad(CAST(800+(frame*7+node_id)%190 AS STRING),3,'0'), '), 0.', lpad(CAST(800+(frame*11)%190 AS STRING),3,'0'), ', 0.95]') END AS line
FROM v_trace CROSS JOIN (VALUES (0),(1),(2)) AS t(k)
"""


def with_views(sql: str) -> str:
    """sql with the views that it names, and those that they name, put before it as common table expressions."""
    need: list[str] = []

    def visit(text: str) -> None:
        for v in VIEWS:
            if re.search(rf"\b{v}\b", text) and v not in need:
                visit(VIEWS[v])
                need.append(v)

    visit(sql)
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in need)
    if not need:
        return sql
    head = re.match(r"\s*WITH(\s+RECURSIVE)?\s", sql, re.I)
    return f"WITH{head[1] or ''} {ctes}, {sql[head.end():]}" if head else f"WITH {ctes} {sql}"


#: A row of a supplier becomes thousands of voxels, nodes and elements: its table, one small file, would make them all in one task.
GROWS = {"supplier": ("s_suppkey", ("v_vox", "v_node", "v_elem"))}


#: A partition holds about so many rows that grow: what a task keeps of their voxels (690,000) or elements has the same
#: size however many rows there are.
LOT = 100


def _dealt(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """rows by key in as many partitions as the session shuffles into, no fewer than it has cores, and no fewer than one for LOT
    rows: a number that is given is not made smaller again by the size of the rows."""
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-rows.count() // LOT))
    return rows.repartition(parts, key)


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A Spark query over the given tables of sf_dir and the views."""
    text = with_views(sql)
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\b{t}\b", text)}
    for t, (key, views) in GROWS.items():
        if t in used and any(re.search(rf"\b{v}\b", text) for v in views):
            used[t] = _dealt(spark, used[t], key)
    for t in used:
        text = re.sub(rf"\b{t}\b(?!\s*\()", "{" + t + "}", text)
    return spark.sql(text, **used)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return frame(spark, sf_dir, f"SELECT * FROM {name}")
