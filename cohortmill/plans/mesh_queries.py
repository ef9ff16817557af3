"""Queries of meshes and fibres."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from cohortmill.operators import fibers, mesh
from cohortmill.plans.base import query

_P = ", ".join(f"p{k}.{a} AS {a}{k}" for k in range(4) for a in "xyz")
# one key for mesh and node: on two, the engine joins the corners to one another by mesh alone
_C = f"SELECT e.*, {_P} FROM v_elem e " + " ".join(f"JOIN v_node p{k} ON p{k}.mesh_id * 1000 + p{k}.node_id = e.mesh_id * 1000 + e.n{k}" for k in range(4))


def _d(a: int, b: int, c: str) -> str:
    return f"({c}{b} - {c}{a})"


def _cross(o: int, a: int, b: int) -> tuple[str, str, str]:
    """Components of (p_a - p_o) x (p_b - p_o)."""
    x, y, z = ((_d(o, a, c), _d(o, b, c)) for c in "xyz")
    return f"({y[0]} * {z[1]} - {z[0]} * {y[1]})", f"({z[0]} * {x[1]} - {x[0]} * {z[1]})", f"({x[0]} * {y[1]} - {y[0]} * {x[1]})"


def _norm(v: tuple[str, str, str]) -> str:
    return f"sqrt({v[0]} * {v[0]} + {v[1]} * {v[1]} + {v[2]} * {v[2]})"


_N = _cross(0, 2, 3)
_DET = f"({_d(0, 1, 'x')} * {_N[0]} + {_d(0, 1, 'y')} * {_N[1]} + {_d(0, 1, 'z')} * {_N[2]})"
_LEN = [f"sqrt(({_d(a, b, 'x')}) ** 2 + ({_d(a, b, 'y')}) ** 2 + ({_d(a, b, 'z')}) ** 2)" for a, b in combinations(range(4), 2)]
_EDGES = "[" + ", ".join(_LEN) + "]"


def _coords(t):
    return mesh.with_coordinates(t.v_elem, t.v_node)


def _rounded(df, digits=6, nudge=0.0):
    """Doubles rounded; a nudge, larger than the engines' differences, moves exact halves off the edge in both."""
    return df.select(*[(F.round(F.col(c) + nudge, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_NUDGE = 1.3e-9


def _nudged(sql: str) -> str:
    return sql.replace(", 6)", f" + {_NUDGE}, 6)")


@query(f"WITH c AS ({_C}) SELECT mesh_id, count(*) AS n, round(sum(x0 + 2 * y1 + 3 * z2 + 4 * x3), 4) AS mix FROM c GROUP BY 1")
def j01_element_coords(t):
    mix = F.col("x0") + 2 * F.col("y1") + 3 * F.col("z2") + 4 * F.col("x3")
    return _coords(t).groupBy("mesh_id").agg(F.count("*").alias("n"), F.round(F.sum(mix), 4).alias("mix"))


# every node gets an even number and a twin of odd number that no element uses
_USED = "SELECT DISTINCT mesh_id, 2 * unnest([n0, n1, n2, n3]) AS node_id FROM v_elem"


def _with_orphans(t):
    nodes = t.v_node.withColumn("node_id", F.explode(F.array(2 * F.col("node_id"), 2 * F.col("node_id") + 1)))
    return nodes, t.v_elem.withColumns({f"n{k}": 2 * F.col(f"n{k}") for k in range(4)})


@query(f"""WITH u AS ({_USED}), k AS (SELECT mesh_id, node_id, row_number() OVER (PARTITION BY mesh_id ORDER BY node_id) - 1 AS new_id FROM u),
x AS (SELECT mesh_id, elem_id, unnest([0, 1, 2, 3]) AS c, 2 * unnest([n0, n1, n2, n3]) AS node_id FROM v_elem)
SELECT x.mesh_id, elem_id, max(CASE WHEN c = 0 THEN new_id END) AS n0, max(CASE WHEN c = 1 THEN new_id END) AS n1, max(CASE WHEN c = 2 THEN new_id END) AS n2, max(CASE WHEN c = 3 THEN new_id END) AS n3
FROM x JOIN k ON k.mesh_id = x.mesh_id AND k.node_id = x.node_id GROUP BY 1, 2""")
def j02_drop_orphans(t):
    return mesh.drop_orphans(*_with_orphans(t))[1].select("mesh_id", "elem_id", "n0", "n1", "n2", "n3")


@query(f"""WITH u AS ({_USED}) SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY node_id) - 1 AS new_id, CASE WHEN node_id % 8 = 0 THEN 1.0 ELSE 0.5 END AS fx, CASE WHEN node_id % 8 = 0 THEN 0.0 ELSE node_id / 2.0 END AS fy FROM u""")
def j03_reindex_attribute(t):
    nodes, elements = _with_orphans(t)
    kept, _ = mesh.drop_orphans(nodes, elements)
    att = nodes.where("node_id % 8 > 0").select("mesh_id", "node_id", F.lit(0.5).alias("fx"), (F.col("node_id") / 2.0).alias("fy"), F.lit(0.0).alias("fz"))
    return mesh.carried(kept, att).select("mesh_id", "new_id", "fx", "fy")


@query("SELECT a.mesh_id, a.node_id AS a_id, b.node_id + 1000 AS b_id FROM v_node a JOIN v_node b ON a.mesh_id = b.mesh_id AND round(a.x, 6) = round(b.x, 6) AND round(a.y, 6) = round(b.y, 6) AND round(a.z, 6) = round(b.z, 6)")
def j04_match_by_coordinate(t):
    b = t.v_node.withColumn("node_id", F.col("node_id") + 1000).withColumn("x", F.col("x") + 1e-9)
    return mesh.match_by_coordinate(t.v_node, b)


@query("""WITH b AS (SELECT mesh_id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM v_node GROUP BY 1),
d AS (SELECT n.mesh_id, k.i AS probe, node_id, sqrt((lx + k.i / 7.0 * (hx - lx) - x) ** 2 + (ly + k.i / 7.0 * (hy - ly) - y) ** 2 + (lz + k.i / 7.0 * (hz - lz) - z) ** 2) AS d FROM v_node n JOIN b USING (mesh_id) CROSS JOIN range(8) AS k(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY mesh_id, probe ORDER BY round(d, 9), node_id) AS r FROM d)
SELECT mesh_id, CAST(probe AS BIGINT) AS probe, round(d, 6) AS distance FROM r WHERE r = 1""")
def j05_nearest_node(t):
    return mesh.nearest_node(mesh.diagonal_probes(t.v_node), t.v_node).select("mesh_id", F.col("probe").cast("long").alias("probe"), F.round("distance", 6).alias("distance"))


@query("""WITH f AS (SELECT mesh_id, node_id, (node_id % 7) - 3.0 AS fx, (node_id % 5) - 2.0 AS fy, 1.0 AS fz FROM v_node), m AS (SELECT e.mesh_id, elem_id, avg(fx) AS x, avg(fy) AS y, avg(fz) AS z
 FROM (SELECT mesh_id, elem_id, unnest([n0, n1, n2, n3]) AS node_id FROM v_elem) e JOIN f ON f.mesh_id = e.mesh_id AND f.node_id = e.node_id GROUP BY 1, 2)
SELECT mesh_id, elem_id, round(x / sqrt(x * x + y * y + z * z), 6) + 0.0 AS fx, round(y / sqrt(x * x + y * y + z * z), 6) + 0.0 AS fy, round(z / sqrt(x * x + y * y + z * z), 6) + 0.0 AS fz FROM m""")
def j08_element_fibers(t):
    f = t.v_node.select("mesh_id", "node_id", ((F.col("node_id") % 7) - 3.0).alias("fx"), ((F.col("node_id") % 5) - 2.0).alias("fy"), F.lit(1.0).alias("fz"))
    return _rounded(mesh.element_vectors(t.v_elem, f))


@query(f"WITH c AS ({_C}) SELECT mesh_id, elem_id, round({_DET} / 6, 6) AS signed, round(abs({_DET}) / 6, 6) AS volume FROM c")
def a06_tet_volume(t):
    v = mesh.signed_volume()
    return _rounded(_coords(t).select("mesh_id", "elem_id", v.alias("signed"), F.abs(v).alias("volume")))


@query(_nudged(f"""WITH c AS ({_C}), j AS (SELECT mesh_id, abs({_DET}) / 6 AS j, list_min({_EDGES}) AS a, list_max({_EDGES}) AS b, list_sum({_EDGES}) / 6 AS m FROM c)
SELECT mesh_id, count(*) AS n_elements, round(min(j), 6) AS min_jacobian, round(avg(j), 6) AS mean_jacobian, count_if(j <= 0) AS n_degenerate, round(min(a), 6) AS edge_min, round(max(b), 6) AS edge_max, round(avg(m), 6) AS edge_mean,
 round(100.0 * count_if(j <= 0) / count(*), 6) AS pct_degenerate, min(j) > 0 AND 100.0 * count_if(j <= 0) / count(*) < 0.1 AS passed, max(b) > 3 AS long_edges FROM j GROUP BY 1"""))
def a07_mesh_qc(t):
    return _rounded(mesh.mesh_qc(_coords(t)), nudge=_NUDGE)


@query(_nudged(f"""WITH c AS ({_C}), a AS (SELECT mesh_id, min({_DET}) AS lo, max({_DET}) AS hi, avg({_DET}) AS m, count_if({_DET} <= 0) AS b, count(*) AS n FROM c WHERE mesh_id % 7 > 0 GROUP BY 1)
SELECT s_suppkey AS mesh_id, round(lo, 6) AS det_min, round(hi, 6) AS det_max, round(m, 6) AS det_mean, b AS n_bad, n, n IS NOT NULL AND coalesce(lo > 0, false) AS all_positive, n IS NOT NULL AND coalesce(100.0 * b / n < 0.1, false) AS few_bad,
 CASE WHEN n IS NULL THEN 'error' ELSE 'ok' END AS status FROM supplier LEFT JOIN a ON mesh_id = s_suppkey"""))
def a08_mesh_qc_signed(t):
    return _rounded(mesh.mesh_qc_signed(t.supplier.select(F.col("s_suppkey").alias("mesh_id")), _coords(t).where("mesh_id % 7 > 0")), nudge=_NUDGE)


@query(f"""WITH c AS ({_C}), e AS (SELECT mesh_id, unnest({_EDGES}) AS e FROM c), n AS (SELECT mesh_id, count(*) AS n_nodes FROM v_node GROUP BY 1)
SELECT mesh_id, any_value(n_nodes) AS n_nodes, CAST(count(*) / 6 AS BIGINT) AS n_elements, round(min(e), 6) AS h_min, round(max(e), 6) AS h_max, round(median(e), 6) AS h_median, count_if(e < 2.0) AS n_short, round(100.0 * count_if(e < 2.0) / count(*), 6) AS pct_short
FROM e JOIN n USING (mesh_id) GROUP BY 1""")
def a09_mesh_quality_report(t):
    return _rounded(mesh.mesh_quality_report(t.v_node, _coords(t), short=2.0))


_MOVED = "SELECT mesh_id, node_id, x * 1.1 AS x, y * 0.9 + 0.01 * (node_id % 3) AS y, z FROM v_node"


@query(_nudged(f"WITH c AS ({_C}), d AS ({_C.replace('v_node', 'm')}), m AS ({_MOVED}), a AS (SELECT mesh_id, sum(abs({_DET})) / 6000 AS v FROM c GROUP BY 1), b AS (SELECT mesh_id, sum(abs({_DET})) / 6000 AS v FROM d GROUP BY 1) SELECT mesh_id, round(a.v, 6) AS rest_ml, round(b.v, 6) AS deformed_ml, round((b.v - a.v) / a.v, 6) AS change FROM a JOIN b USING (mesh_id)".replace("WITH c AS", "WITH m AS (" + _MOVED + "), c AS", 1).replace(f", m AS ({_MOVED}), a AS", ", a AS", 1)))
def a10_tissue_volume(t):
    places = {"dx": F.col("x") + F.col("x") * 0.1, "dy": F.col("y") + (F.col("y") * -0.1 + 0.01 * (F.col("node_id") % 3)), "dz": F.col("z") + 0.0}
    return _rounded(mesh.volume_change_of(mesh.with_coordinates(t.v_elem, t.v_node.withColumns(places), (*"xyz", *places))), nudge=_NUDGE)


_FACES = "SELECT mesh_id, elem_id, unnest([list_sort([n1, n2, n3]), list_sort([n0, n2, n3]), list_sort([n0, n1, n3]), list_sort([n0, n1, n2])]) AS face FROM v_elem"


@query(f"WITH f AS ({_FACES}), i AS (SELECT mesh_id, face, count(*) AS n, min(elem_id) AS first_cell FROM f GROUP BY 1, 2) SELECT mesh_id, n, count(*) AS faces, CAST(sum(first_cell) AS BIGINT) AS cells FROM i GROUP BY 1, 2")
def a11_face_incidence(t):
    return mesh.face_incidence(t.v_elem).groupBy("mesh_id", "n").agg(F.count("*").alias("faces"), F.sum(F.col("cells")[0]).alias("cells"))


@query(f"WITH f AS ({_FACES}), i AS (SELECT mesh_id, face, count(*) AS n, min(elem_id) AS elem_id FROM f GROUP BY 1, 2) SELECT mesh_id, elem_id, face[1] AS a, face[2] AS b, face[3] AS c FROM i WHERE n = 1")
def a12_boundary_faces(t):
    b = mesh.boundary_faces(t.v_elem)
    s = F.array_sort(F.array("a", "b", "c"))
    return b.select("mesh_id", "elem_id", *[s[k].alias(c) for k, c in enumerate("abc")])


@query("""WITH f AS (SELECT mesh_id, elem_id, u.v AS v, u.o AS o, list_sort(u.v) AS face FROM (SELECT mesh_id, elem_id, unnest([{'v': [n1, n2, n3], 'o': n0}, {'v': [n0, n2, n3], 'o': n1}, {'v': [n0, n1, n3], 'o': n2}, {'v': [n0, n1, n2], 'o': n3}]) AS u FROM v_cup)),
b AS (SELECT mesh_id, any_value(v) AS v, any_value(o) AS o FROM f GROUP BY mesh_id, face HAVING count(*) = 1), m AS (SELECT mesh_id, max(z) AS top FROM v_node GROUP BY 1),
g AS (SELECT b.mesh_id, least(p.z, q.z, r.z) > top - 1 AS base FROM b JOIN m USING (mesh_id) JOIN v_node p ON p.mesh_id * 1000 + p.node_id = b.mesh_id * 1000 + v[1] JOIN v_node q ON q.mesh_id * 1000 + q.node_id = b.mesh_id * 1000 + v[2] JOIN v_node r ON r.mesh_id * 1000 + r.node_id = b.mesh_id * 1000 + v[3])
SELECT mesh_id, count(*) AS n_faces, count_if(base) AS n_base FROM g GROUP BY 1""")
def a13_cavity_faces(t):
    g = mesh.boundary_geometry(t.v_cup, t.v_node)
    return g.groupBy("mesh_id").agg(F.count("*").alias("n_faces"), F.count_if(F.col("kind") == "base").alias("n_base"))


_KEY = "mesh_id * 1000 + {p}.node_id = b.mesh_id * 1000 + "
_VOLUME = f"""WITH f AS (SELECT mesh_id, u.v AS v, u.o AS o, list_sort(u.v) AS face FROM (SELECT mesh_id, unnest([{{'v': [n1, n2, n3], 'o': n0}}, {{'v': [n0, n2, n3], 'o': n1}}, {{'v': [n0, n1, n3], 'o': n2}}, {{'v': [n0, n1, n2], 'o': n3}}]) AS u FROM v_cup)),
b AS (SELECT mesh_id, any_value(v) AS v, any_value(o) AS o FROM f GROUP BY mesh_id, face HAVING count(*) = 1), m AS (SELECT mesh_id, max(z) AS top, avg(x) AS cx, avg(y) AS cy FROM v_node GROUP BY 1),
g AS (SELECT b.mesh_id, v, {", ".join(f"p{k}.{a} AS {a}{k}" for k in range(4) for a in "xyz")}, top, cx, cy FROM b JOIN m USING (mesh_id) {" ".join(f"JOIN v_node p{k} ON p{k}.{_KEY.format(p=f'p{k}')}{x}" for k, x in enumerate(("v[1]", "v[2]", "v[3]", "o")))}),
n AS (SELECT *, {", ".join(f"{x} AS n{a}" for a, x in zip("xyz", _cross(0, 1, 2), strict=True))} FROM g),
u AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len, CASE WHEN nx * (x3 - x0) + ny * (y3 - y0) + nz * (z3 - z0) > 0 THEN -1 ELSE 1 END AS turn, {", ".join(f"({a}0 + {a}1 + {a}2) / 3 AS m{a}" for a in "xyz")} FROM n),
k AS (SELECT *, CASE WHEN least(z0, z1, z2) > top - 1 THEN 'base' WHEN sqrt((mx - cx) ** 2 + (my - cy) ** 2) >= 1e-9 THEN CASE WHEN turn * (nx * (mx - cx) + ny * (my - cy)) < 0 THEN 'endo' ELSE 'epi' END END AS kind FROM u WHERE len >= 1e-12),
w AS (SELECT mesh_id, sum(CASE WHEN kind = 'endo' THEN -turn * (mx * nx + my * ny + mz * nz) / 2 ELSE 0 END) AS v FROM k GROUP BY 1),
r AS (SELECT DISTINCT mesh_id, node_id, x, y, z FROM (SELECT mesh_id, top, unnest([{{'node_id': v[1], 'x': x0, 'y': y0, 'z': z0}}, {{'node_id': v[2], 'x': x1, 'y': y1, 'z': z1}}, {{'node_id': v[3], 'x': x2, 'y': y2, 'z': z2}}], recursive := true) FROM k WHERE kind = 'endo') q WHERE z > top - 1),
c AS (SELECT mesh_id, avg(x) AS ax, avg(y) AS ay, avg(z) AS az FROM r GROUP BY 1 HAVING count(*) >= 3),
o AS (SELECT r.*, ax, ay, az, row_number() OVER w AS i, count(*) OVER (PARTITION BY r.mesh_id) AS n FROM r JOIN c USING (mesh_id) WINDOW w AS (PARTITION BY r.mesh_id ORDER BY atan2(y - ay, x - ax), node_id)),
t AS (SELECT o.mesh_id, o.ax AS x0, o.ay AS y0, o.az AS z0, o.x AS x1, o.y AS y1, o.z AS z1, q.x AS x2, q.y AS y2, q.z AS z2 FROM o JOIN o q ON q.mesh_id = o.mesh_id AND q.i = o.i % o.n + 1),
l AS (SELECT mesh_id, sum(CASE WHEN {_norm(_cross(0, 1, 2))} >= 2e-12 THEN ({" + ".join(f"({a}0 + {a}1 + {a}2) / 3 * {x}" for a, x in zip("xyz", _cross(0, 1, 2), strict=True))}) / 2 * CASE WHEN {_cross(0, 1, 2)[2]} < 0 THEN -1 ELSE 1 END ELSE 0 END) AS v FROM t GROUP BY 1)
SELECT w.mesh_id, round((w.v + coalesce(l.v, 0)) / 3000, 6) AS volume_ml FROM w LEFT JOIN l ON l.mesh_id = w.mesh_id"""


@query(_VOLUME)
def a13_cavity_volume(t):
    return _rounded(mesh.cavity_volume_divergence(t.v_cup, t.v_node).select("mesh_id", "volume_ml"))


@query("""WITH b AS (SELECT mesh_id, min(z) AS z0, (max(z) - min(z)) / 40 AS dz, avg(x) AS cx, avg(y) AS cy FROM v_node GROUP BY 1),
s AS (SELECT mesh_id, z0, dz, CAST(floor((z - z0) / dz) AS INT) AS k, z, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r FROM v_node JOIN b USING (mesh_id)),
a AS (SELECT mesh_id, k, pi() * quantile_cont(r, 0.1) ** 2 * CASE WHEN k IN (0, 39) THEN 0.5 ELSE 1 END AS a FROM s WHERE k BETWEEN 0 AND 39 AND abs(z - (z0 + (k + 0.5) * dz)) < dz / 2 GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT b.mesh_id, round(coalesce(sum(a), 0) * any_value(dz) / 1000, 6) AS volume_ml FROM b LEFT JOIN a ON a.mesh_id = b.mesh_id GROUP BY 1""")
def a14_cavity_slices(t):
    return _rounded(mesh.cavity_volume_slices(t.v_node))


@query("SELECT idx, CASE WHEN n > 25 AND p1 > 0 THEN round(100.0 * (p1 - p1 * p2) / p1, 6) END AS ef FROM v_doe")
def a15_ejection_fraction(t):
    ef = mesh.ejection_fraction(F.col("p1"), F.col("p1") * F.col("p2"), F.col("n") > 25)
    return t.v_doe.select("idx", F.round(ef, 6).alias("ef"))


@query("""WITH b AS (SELECT mesh_id, (min(z) + max(z)) / 2 AS zm FROM v_node GROUP BY 1), m AS (SELECT n.* FROM v_node n JOIN b USING (mesh_id) WHERE abs(z - zm) < 5), c AS (SELECT mesh_id, avg(x) AS cx, avg(y) AS cy FROM m GROUP BY 1 HAVING count(*) >= 10),
r AS (SELECT mesh_id, node_id, x - cx AS rx, y - cy AS ry, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r, 0.1 * x AS ux, 0.2 * y AS uy FROM m JOIN c USING (mesh_id)), q AS (SELECT mesh_id, median(r) AS rm FROM r GROUP BY 1),
o AS (SELECT mesh_id, avg((rx * ux + ry * uy) / r) FILTER (round(r, 9) < round(rm, 9)) AS endo, avg((rx * ux + ry * uy) / r) FILTER (round(r, 9) >= round(rm, 9)) AS epi FROM r JOIN q USING (mesh_id) WHERE round(r, 9) > 0.1 GROUP BY 1)
SELECT b.mesh_id, round(coalesce(endo, 0), 5) + 0.0 AS endo, round(coalesce(epi, 0), 5) + 0.0 AS epi FROM b LEFT JOIN o ON o.mesh_id = b.mesh_id""")
def a16_radial_displacement(t):
    u = t.v_node.select("mesh_id", "node_id", (F.col("x") * 0.1).alias("ux"), (F.col("y") * 0.2).alias("uy"))
    return _rounded(mesh.radial_displacement(t.v_node, u), 5)


@query("SELECT mesh_id, node_id, round(1 / sqrt(6), 6) AS gx, round(2 / sqrt(6), 6) AS gy, round(-1 / sqrt(6), 6) AS gz FROM v_node")
def a17_node_gradient(t):
    """Of a linear field the gradient is the same everywhere: (1, 2, -1) at unit length, the closed form."""
    phi = t.v_node.withColumn("phi", F.col("x") + 2 * F.col("y") - F.col("z"))
    return _rounded(mesh.node_gradient(t.v_elem, phi, "phi"))


_FACE_N = {o: _cross(*f) for o, f in enumerate(mesh.FACES)}


def _dihedral_sql() -> str:
    """Columns nkx, nky, nkz of outward face normals and the least angle of their pairs, as two nested selects."""
    turn = {o: f"CASE WHEN {n[0]} * {_d(f[0], o, 'x')} + {n[1]} * {_d(f[0], o, 'y')} + {n[2]} * {_d(f[0], o, 'z')} > 0 THEN -1 ELSE 1 END" for (o, n), f in zip(_FACE_N.items(), mesh.FACES, strict=True)}
    inner = ", ".join(f"({n[k]}) * ({turn[o]}) / greatest({_norm(n)}, 1e-12) AS n{o}{a}" for o, n in _FACE_N.items() for k, a in enumerate("xyz"))
    pair = ", ".join(f"degrees(acos(greatest(-1.0, least(1.0, -(n{i}x * n{j}x + n{i}y * n{j}y + n{i}z * n{j}z)))))" for i, j in combinations(range(4), 2))
    return f"SELECT mesh_id, elem_id, least({pair}) AS a FROM (SELECT mesh_id, elem_id, {inner} FROM c)"


@query(f"WITH c AS ({_C}), d AS ({_dihedral_sql()}) SELECT mesh_id, CAST(l AS DOUBLE) AS \"limit\", count_if(a < l) AS n, round(100.0 * count_if(a < l) / count(*), 6) AS pct FROM d CROSS JOIN (VALUES (10), (20), (30), (42.5)) AS q(l) GROUP BY 1, 2")
def a27_dihedral_histogram(t):
    return _rounded(mesh.dihedral_histogram(_coords(t), (10, 20, 30, 42.5)))


@query(f"""WITH c AS ({_C}), a AS (SELECT mesh_id, elem_id % 4 AS tag, sum({_norm(_cross(0, 1, 2))} / 2) AS area FROM c GROUP BY 1, 2)
SELECT mesh_id, tag, round(area, 5) AS area, row_number() OVER (PARTITION BY mesh_id ORDER BY area DESC, tag) = 1 AS kept FROM a""")
def a28_surface_components(t):
    tri = _coords(t).withColumn("tag", F.col("elem_id") % 4)
    return _rounded(mesh.surface_components(tri), 5)


@query("WITH l AS (SELECT mesh_id, quantile_cont(z, 0.1) AS l FROM v_node GROUP BY 1) SELECT mesh_id, round(l, 6) AS \"limit\", count_if(z < l) AS n_below, round(100.0 * count_if(z < l) / count(*), 6) AS pct FROM v_node JOIN l USING (mesh_id) GROUP BY mesh_id, l")
def a29_below_percentile(t):
    return _rounded(mesh.below_percentile_share(t.v_node, "z"))


@query("""WITH b AS (SELECT mesh_id, (min(z) + max(z)) / 2 AS zm, max(z) - min(z) AS h, avg(x) AS cx, avg(y) AS cy FROM v_node GROUP BY 1), r AS (SELECT mesh_id, node_id, sqrt((x - cx) ** 2 + (y - cy) ** 2) AS r, abs(z - zm) < 0.15 * h AS mid FROM v_node JOIN b USING (mesh_id)),
w AS (SELECT mesh_id, max(r) - min(r) AS w FROM r WHERE mid GROUP BY 1), e AS (SELECT mesh_id, elem_id, unnest([n0, n1, n2, n3]) AS node_id FROM v_elem),
s AS (SELECT mesh_id, elem_id, max(r) - min(r) AS s FROM e JOIN r USING (mesh_id, node_id) GROUP BY 1, 2 HAVING bool_and(mid)), p AS (SELECT mesh_id, 100 * s / w AS p FROM s JOIN w USING (mesh_id))
SELECT mesh_id, round(median(p), 6) AS median_pct, round(count_if(p > 30) / count(*), 6) AS share_30, round(count_if(p > 50) / count(*), 6) AS share_50 FROM p GROUP BY 1""")
def a30_radial_span(t):
    return _rounded(mesh.radial_span(t.v_elem, t.v_node))


_PHI = """c AS (SELECT mesh_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM v_node GROUP BY 1), d AS (SELECT mesh_id, node_id, z, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS d FROM v_node JOIN c USING (mesh_id)),
r AS (SELECT mesh_id, min(d) AS lo, max(d) AS hi, min(z) AS zl, max(z) AS zh FROM d GROUP BY 1)"""


@query(f"WITH {_PHI} SELECT mesh_id, node_id, round((d - lo) / (hi - lo), 6) AS phi_epi, round(((z - zl) / (zh - zl)) / (1 + 1e-10), 6) AS phi_ab FROM d JOIN r USING (mesh_id)")
def w03_minmax_coordinate(t):
    return _rounded(mesh.apex_base(mesh.transmural(t.v_node)).select("mesh_id", "node_id", "phi_epi", "phi_ab"))


def _fibres(t):
    nodes = mesh.apex_base(mesh.transmural(t.v_node))
    both = mesh.node_gradients(t.v_elem, nodes, {"phi_ab": "l", "phi_epi": "t"})
    return fibers.fiber_rule(nodes.join(both, ["mesh_id", "node_id"]))


def _gradients_sql() -> str:
    """CTEs up to h: per node the unit gradients l and t of phi_ab and phi_epi."""
    cols = ", ".join(f"p{k}.{a} AS {a}{k}" for k in range(4) for a in ("x", "y", "z", "ab", "ep"))
    sides = {1: _cross(0, 2, 3), 2: _cross(0, 3, 1), 3: _cross(0, 1, 2)}
    weigh = lambda f, i: " + ".join(f"{sides[k][i]} * ({f}{k} - {f}0)" for k in (1, 2, 3))
    grads = ", ".join(f"({weigh(f, i)}) / det * abs(det) / 6 AS {g}{a}" for f, g in (("ab", "l"), ("ep", "t")) for i, a in enumerate("xyz"))
    names = [g + a for g in "lt" for a in "xyz"]
    unit = ", ".join(f"CASE WHEN sqrt({g}x * {g}x + {g}y * {g}y + {g}z * {g}z) > 1e-12 THEN {g}{a} / sqrt({g}x * {g}x + {g}y * {g}y + {g}z * {g}z) ELSE {g}{a} END AS {g}{a}" for g in "lt" for a in "xyz")
    return f"""{_PHI}, n AS (SELECT mesh_id, node_id, v.x, v.y, v.z, (d - lo) / (hi - lo) AS ep, ((v.z - zl) / (zh - zl)) / (1 + 1e-10) AS ab FROM v_node v JOIN d USING (mesh_id, node_id) JOIN r USING (mesh_id)),
q AS (SELECT e.mesh_id, e.n0, e.n1, e.n2, e.n3, {cols} FROM v_elem e {" ".join(f"JOIN n p{k} ON p{k}.mesh_id * 1000 + p{k}.node_id = e.mesh_id * 1000 + e.n{k}" for k in range(4))}),
w AS (SELECT *, {_DET} AS det FROM q), g AS (SELECT mesh_id, unnest([n0, n1, n2, n3]) AS node_id, abs(det) / 6 AS w, {grads} FROM w WHERE det <> 0),
s AS (SELECT mesh_id, node_id, {", ".join(f"CASE WHEN sum(w) > 1e-12 THEN sum({c}) / sum(w) ELSE sum({c}) END AS {c}" for c in names)} FROM g GROUP BY 1, 2),
h AS (SELECT mesh_id, node_id, {unit} FROM s)"""


def _v(p: str) -> tuple[str, str, str]:
    return tuple(p + a for a in "xyz")


def _x(a: tuple, b: tuple) -> tuple[str, str, str]:
    return f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})"


def _as(v: tuple, p: str) -> str:
    return ", ".join(f"{x} AS {p}{a}" for x, a in zip(v, "xyz", strict=True))


def _unit_sql(p: str, otherwise: tuple | None = None) -> str:
    n = _norm(_v(p))
    return ", ".join(f"CASE WHEN {n} > 1e-10 THEN {p}{a} / {n} ELSE {p + a if otherwise is None else otherwise[k]} END AS {p}{a}" for k, a in enumerate("xyz"))


def _turned_sql(a: str, b: tuple, angle: str) -> tuple:
    return tuple(f"({a}{c} * cos({angle}) + {y} * sin({angle}))" for c, y in zip("xyz", b, strict=True))


_FIBRES = f"""WITH {_gradients_sql()}, a AS (SELECT h.*, ep, {_as(_x(_v("l"), _v("t")), "c")} FROM h JOIN n USING (mesh_id, node_id)),
b AS (SELECT mesh_id, node_id, ep, tx, ty, tz, {_unit_sql("c", (1, 0, 0))} FROM a), i AS (SELECT *, {_as(_turned_sql("c", _x(_v("t"), _v("c")), "radians(60 - 120 * ep)"), "f")} FROM b),
j AS (SELECT mesh_id, node_id, ep, tx, ty, tz, {_unit_sql("f")} FROM i), k AS (SELECT *, {_as(_turned_sql("t", _x(_v("f"), _v("t")), "radians(25 * ep)"), "s")} FROM j),
o AS (SELECT mesh_id, node_id, fx, fy, fz, {_unit_sql("s")} FROM k)
SELECT mesh_id, node_id, {", ".join(f"round({x}, 5) + 0.0 AS {p}{a}" for p, v in (("f", _v("f")), ("s", _v("s")), ("n", _x(_v("f"), _v("s")))) for x, a in zip(v, "xyz", strict=True))} FROM o"""


@query(_FIBRES)
def w15_fiber_rule(t):
    return _rounded(_fibres(t).select("mesh_id", "node_id", *[f"{k}{a}" for k in "fsn" for a in "xyz"]), 5)


def _soft_sql(p: str) -> str:
    return ", ".join(f"{p}{a} / ({_norm(_v(p))} + 1e-8) AS {p}{a}" for a in "xyz")


_ELEMENT_FIBRES = f"""WITH q AS ({_C}), m AS (SELECT mesh_id, elem_id, {", ".join(f"({a}0 + {a}1 + {a}2 + {a}3) / 4 AS m{a}" for a in "xyz")} FROM q), o AS (SELECT mesh_id, {", ".join(f"avg(m{a}) AS o{a}" for a in "xyz")} FROM m GROUP BY 1),
d AS (SELECT mesh_id, elem_id, mx - ox AS rx, my - oy AS ry, mz - oz AS rz, sqrt((mx - ox) ** 2 + (my - oy) ** 2 + (mz - oz) ** 2) AS d FROM m JOIN o USING (mesh_id)), e AS (SELECT mesh_id, min(d) AS d0, max(d) AS d1 FROM d GROUP BY 1),
a AS (SELECT mesh_id, elem_id, (d - d0) / (d1 - d0 + 1e-8) AS t, {_soft_sql("r")} FROM d JOIN e USING (mesh_id)), b AS (SELECT *, -ry AS cx, rx AS cy, CAST(0 AS DOUBLE) AS cz FROM a), c AS (SELECT mesh_id, elem_id, t, rx, ry, rz, {_soft_sql("c")} FROM b),
f AS (SELECT *, {_as(_turned_sql("c", _v("r"), "radians(-60 + 120 * t)"), "f")} FROM c), g AS (SELECT mesh_id, elem_id, t, rx, ry, rz, {_soft_sql("f")} FROM f),
s AS (SELECT *, {_as(_turned_sql("r", _x(_v("f"), _v("r")), "radians(20 - 40 * t)"), "s")} FROM g), h AS (SELECT mesh_id, elem_id, fx, fy, fz, {_soft_sql("s")} FROM s)
SELECT mesh_id, elem_id, {", ".join(f"round({p}{a}, 5) + 0.0 AS {p}{a}" for p in "fs" for a in "xyz")} FROM h"""


@query(_ELEMENT_FIBRES)
def w16_fiber_rule_element(t):
    f = fibers.fiber_rule_element(_coords(t))
    return _rounded(f.select("mesh_id", "elem_id", *[f"{k}{a}" for k in "fs" for a in "xyz"]), 5)


@query("""WITH c AS (SELECT mesh_id, avg(x) AS cx, avg(y) AS cy FROM v_node GROUP BY 1), r AS (SELECT mesh_id, node_id, x - cx AS rx, y - cy AS ry, greatest(sqrt((x - cx) ** 2 + (y - cy) ** 2), 1e-6) AS n FROM v_node JOIN c USING (mesh_id))
SELECT mesh_id, node_id, round(-ry / n, 6) + 0.0 AS fx, round(rx / n, 6) + 0.0 AS fy, 0.0::DOUBLE AS fz FROM r""")
def w17_fiber_tangential(t):
    return _rounded(fibers.fiber_tangential(t.v_node))


@query("""WITH f AS (SELECT mesh_id, node_id, (node_id % 3) - 1.0 AS fx, (node_id % 5) - 2.0 AS fy FROM v_node), n AS (SELECT *, sqrt(fx * fx + fy * fy) AS n FROM f)
SELECT mesh_id, node_id, CASE WHEN n > 1e-10 THEN round(fy / n, 6) + 0.0 ELSE 0 END AS sx, CASE WHEN n > 1e-10 THEN round(-fx / n, 6) + 0.0 ELSE 1 END AS sy, 0.0::DOUBLE AS sz FROM n""")
def w20_sheet_from_fiber(t):
    f = t.v_node.select("mesh_id", "node_id", ((F.col("node_id") % 3) - 1.0).alias("fx"), ((F.col("node_id") % 5) - 2.0).alias("fy"), F.lit(0.3).alias("fz"))
    return _rounded(fibers.sheet_from_fiber(f, ["mesh_id", "node_id"]))


@query("WITH r AS (SELECT mesh_id, node_id, row_number() OVER (PARTITION BY mesh_id ORDER BY z, node_id) AS r FROM v_node) SELECT mesh_id, node_id AS apex FROM r WHERE r = 1")
def k01_apex_node(t):
    return mesh.apex_node(t.v_node)


def _ratio_sql() -> str:
    area = " + ".join(f"{_norm(n)} / 2" for n in _FACE_N.values())
    prod = {"a": (0, 5), "b": (1, 4), "c": (2, 3)}
    sides = ", ".join(f"{_LEN[i]} * {_LEN[j]} AS {k}" for k, (i, j) in prod.items())
    return f"SELECT mesh_id, elem_id, CASE WHEN v > 1e-14 THEN 9 * v / area / (sqrt(abs((a + b + c) * (b + c - a) * (a - b + c) * (a + b - c))) / (24 * v)) ELSE 0 END AS ratio FROM (SELECT mesh_id, elem_id, abs({_DET}) / 6 AS v, {area} AS area, {sides} FROM c)"


@query(f"WITH c AS ({_C}), q AS ({_ratio_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY round(ratio, 9), elem_id) AS r FROM q) SELECT mesh_id, r AS rank, elem_id, round(ratio, 6) AS ratio FROM r WHERE r <= 15")
def k02_worst_elements(t):
    return _rounded(mesh.worst_elements(_coords(t)).withColumn("rank", F.col("rank").cast("long")))


@query(f"WITH c AS ({_C}), d AS ({_dihedral_sql()}) SELECT c.mesh_id, count_if(list_min({_EDGES}) >= 1.95) AS kept_edge, count_if(a >= 40) AS kept_angle, count(*) AS n FROM c JOIN d ON d.mesh_id = c.mesh_id AND d.elem_id = c.elem_id GROUP BY 1")
def u09_filter_elements(t):
    c = _coords(t)
    return c.groupBy("mesh_id").agg(F.count(F.when(mesh.filter_small_elements(c, 1.95), 1)).alias("kept_edge"), F.count(F.when(mesh.min_dihedral() >= 40, 1)).alias("kept_angle"), F.count("*").alias("n"))


@query(f"WITH c AS ({_C}) SELECT mesh_id, elem_id, CASE WHEN {_DET} < 0 THEN n2 ELSE n1 END AS n1, CASE WHEN {_DET} < 0 THEN n1 ELSE n2 END AS n2, {_DET} < 0 AS flipped FROM c")
def u10_fix_orientation(t):
    return mesh.fix_orientation(_coords(t)).select("mesh_id", "elem_id", "n1", "n2", "flipped")


@query(f"WITH c AS ({_C}), q AS ({_ratio_sql()}) SELECT mesh_id, elem_id, round(ratio, 6) AS ratio FROM q")
def u11_radius_ratio(t):
    return _rounded(_coords(t).select("mesh_id", "elem_id", mesh.radius_ratio().alias("ratio")))


@query(f"WITH c AS ({_C}), j AS (SELECT mesh_id, min({_DET}) AS m, 100.0 * count_if({_DET} <= 0) / count(*) AS p FROM c GROUP BY 1) SELECT mesh_id, coalesce(m > 0 AND p < 0.1, false) AS passed FROM j")
def u12_qc_gate(t):
    s = mesh.mesh_qc_signed(t.v_elem.select("mesh_id").distinct(), _coords(t))
    qc = s.select("mesh_id", F.col("det_min").alias("min_jacobian"), (100.0 * F.col("n_bad") / F.col("n")).alias("pct_degenerate"))
    ok, bad = mesh.qc_gate(qc)
    return ok.select("mesh_id", F.lit(True).alias("passed")).unionByName(bad.select("mesh_id", F.lit(False).alias("passed")))
