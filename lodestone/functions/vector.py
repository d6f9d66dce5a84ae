"""Vector arithmetic as Column expressions over array columns, in double precision.

All of them stay in the JVM and take vectors of any length, as columns or names. A null
vector gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least squared norm that a vector counts with.
TINY = 1e-30


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: inside a lambda an expression is computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    squares = F.transform(doubles(a), lambda x: x * x)
    return F.sqrt(F.greatest(F.lit(TINY), total(squares)))


def scaled(a: Column | str, by: Column) -> Column:
    return let(by, lambda s: F.transform(doubles(a), lambda x: x * s))


def normalized(a: Column | str) -> Column:
    return let(doubles(a), lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def l2sq(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (F.lit(v) if not isinstance(v, Column) else v for v in (low, high))
    return F.greatest(low, F.least(high, x))


def angle(a: Column | str, b: Column | str) -> Column:
    """Radians between unit vectors."""
    return F.acos(clamp(dot(a, b), -1.0, 1.0))


def tangent(center: Column | str, z: Column | str) -> Column:
    """z without its part along a unit center."""
    return let(dot(center, z), lambda p: F.zip_with(doubles(z), doubles(center), lambda x, c: x - p * c))


def on_sphere(center: Column | str, direction: Column | str, theta: Column) -> Column:
    """The unit vector at angle theta from a unit center, towards a unit tangent direction."""
    mixed = let(F.struct(F.cos(theta).alias("c"), F.sin(theta).alias("s")), lambda w: F.zip_with(doubles(center), doubles(direction), lambda x, u: w["c"] * x + w["s"] * u))
    return normalized(mixed)


def push_out(center: Column | str, theta: Column, q: Column | str) -> Column:
    """q, or the vector in its direction at angle theta from the center when q is nearer.

    A q at the center itself has no direction and stays.
    """
    moved = let(tangent(center, q), lambda side: F.when(dot(side, side) > TINY, on_sphere(center, normalized(side), theta)).otherwise(doubles(q)))
    return F.when(angle(q, center) < theta, moved).otherwise(doubles(q))
