"""Three-component vectors as tuples of Columns; everything stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str) -> Vec:
    """Columns <prefix>x, <prefix>y, <prefix>z."""
    return F.col(prefix + "x"), F.col(prefix + "y"), F.col(prefix + "z")


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, least: float = 1e-10, otherwise: tuple[float, float, float] | None = None) -> Vec:
    """a over its length; where that is at most `least`, the given vector or a itself."""
    n = norm(a)
    return tuple(F.when(n > least, p / n).otherwise(p if otherwise is None else F.lit(float(otherwise[k]))) for k, p in enumerate(a))


def tet_determinant(p: list[Vec]) -> Column:
    """Six times the signed volume of a tetrahedron."""
    return dot(sub(p[1], p[0]), cross(sub(p[2], p[0]), sub(p[3], p[0])))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))
