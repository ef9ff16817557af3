"""Fibre directions from coordinates and gradients, as Column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortmill.functions.vectors import Vec, add, cross, norm, scale, sub, unit, vec
from cohortmill.operators.mesh import points
from cohortmill.session import written

# Angles in degrees at the inner and outer wall, of fibre and sheet, at nodes and at elements.
NODE_ANGLES = {"fiber": (60.0, -60.0), "sheet": (0.0, 25.0)}
ELEMENT_ANGLES = {"fiber": (-60.0, 60.0), "sheet": (20.0, -20.0)}


def _cols(v: Vec, prefix: str) -> list:
    return [c.alias(prefix + a) for c, a in zip(v, "xyz", strict=True)]


def _turned(a: Vec, b: Vec, angle) -> Vec:
    return add(scale(a, F.cos(angle)), scale(b, F.sin(angle)))


def fiber_rule(nodes: DataFrame, angles: dict = NODE_ANGLES) -> DataFrame:
    """nodes(.., phi_epi, lx ly lz, tx ty tz) with fibre f, sheet s and normal n.

    l is the apex-to-base direction, t the transmural one; their cross product runs around, (1, 0, 0) where it
    has no length. Fibre and sheet turn by angles that go linearly through the wall.
    """
    angle = lambda k: F.radians(F.lit(angles[k][0]) + F.col("phi_epi") * (angles[k][1] - angles[k][0]))
    around = unit(cross(vec("l"), vec("t")), 1e-10, (1.0, 0.0, 0.0))
    rows = nodes.select("*", *_cols(around, "c"))
    rows = rows.select("*", *_cols(unit(_turned(vec("c"), cross(vec("t"), vec("c")), angle("fiber"))), "f")).drop("cx", "cy", "cz")
    rows = rows.select("*", *_cols(unit(_turned(vec("t"), cross(vec("f"), vec("t")), angle("sheet"))), "s"))
    return rows.select("*", *_cols(cross(vec("f"), vec("s")), "n"))


def fiber_rule_element(coords: DataFrame, angles: dict = ELEMENT_ANGLES) -> DataFrame:
    """(mesh_id, elem_id, f, s): by the distance of an element's centroid to the mean centroid; the fibre turns
    in the plane of the radial and the circumferential direction. Lengths are divided by themselves and 1e-8."""
    p = points()
    c = coords.select("mesh_id", "elem_id", *_cols(scale(add(add(p[0], p[1]), add(p[2], p[3])), 0.25), "m"))
    c, _ = written(c, "centroids")  # read three times: for the mean, the ends and the rule
    mid = c.groupBy("mesh_id").agg(*[F.avg(f"m{a}").alias(f"o{a}") for a in "xyz"])
    c = c.join(mid, "mesh_id").withColumn("d", norm(sub(vec("m"), vec("o"))))
    ends = c.groupBy("mesh_id").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    c = c.join(ends, "mesh_id").withColumn("t", (F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0") + 1e-8))
    soft = lambda v: scale(v, 1.0 / (norm(v) + 1e-8))
    angle = lambda k: F.radians(F.lit(angles[k][0]) + F.col("t") * (angles[k][1] - angles[k][0]))
    c = c.select("mesh_id", "elem_id", "t", *_cols(soft(sub(vec("m"), vec("o"))), "r"))
    around = soft((-F.col("ry"), F.col("rx"), F.lit(0.0)))
    c = c.select("*", *_cols(around, "c"))
    c = c.select("*", *_cols(soft(_turned(vec("c"), vec("r"), angle("fiber"))), "f"))
    c = c.select("*", *_cols(soft(_turned(vec("r"), cross(vec("f"), vec("r")), angle("sheet"))), "s"))
    return c.drop("cx", "cy", "cz", "rx", "ry", "rz", "t")


def fiber_tangential(nodes: DataFrame) -> DataFrame:
    """(mesh_id, node_id, f): a quarter turn from the radial direction in the plane, around the mean axis."""
    c = nodes.groupBy("mesh_id").agg(F.avg("x").alias("__cx"), F.avg("y").alias("__cy"))
    rx, ry = F.col("x") - F.col("__cx"), F.col("y") - F.col("__cy")
    n = F.sqrt(rx * rx + ry * ry)
    n = F.when(n < 1e-6, 1.0).otherwise(n)
    return nodes.join(c, "mesh_id").select("mesh_id", "node_id", (-ry / n).alias("fx"), (rx / n).alias("fy"), F.lit(0.0).alias("fz"))


def sheet_from_fiber(fibers: DataFrame, keys: list[str]) -> DataFrame:
    """keys and s: the fibre's cross product with the z axis at unit length, (0, 1, 0) for a fibre along z."""
    s = unit((F.col("fy"), -F.col("fx"), F.lit(0.0)), 1e-10, (0.0, 1.0, 0.0))
    return fibers.select(*keys, *_cols(s, "s"))
