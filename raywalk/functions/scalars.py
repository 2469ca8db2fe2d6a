"""Column functions of the calculations: tolerant comparison, small linear algebra, integer helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 1e-5


def is_same(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= TOLERANCE


def is_more(a: Column, b: Column) -> Column:
    return a - b > TOLERANCE


def is_less(a: Column, b: Column) -> Column:
    return b - a > TOLERANCE


def make_range(start: Column, end: Column, k: int) -> Column:
    """k even points from start on, the end left out."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda u: start + u * (end - start) / k)


def filled(value: Column, k: int) -> Column:
    return F.array_repeat(value, k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    """Vector product of arrays of three."""
    x, y = (lambda i: F.get(a, F.lit(i))), (lambda i: F.get(b, F.lit(i)))
    return F.array(x(1) * y(2) - x(2) * y(1), x(2) * y(0) - x(0) * y(2), x(0) * y(1) - x(1) * y(0))


def angle_between(a: Column, b: Column) -> Column:
    """Angle of two vectors; null if one is zero."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), norm(a) * norm(b)))))


def determinant(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - bx * ay


def length_2d(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def scotts_factor(n: Column, dimensions: int = 1) -> Column:
    return F.pow(n.cast("double"), F.lit(-1.0 / (dimensions + 4)))


def gaussian(d: Column) -> Column:
    return F.exp(-0.5 * d * d)


def next_power_of_two(n: Column) -> Column:
    """Least power of two of at least n, for n of 1 or more."""
    return F.pow(F.lit(2.0), F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("long"))))).cast("long")


def next_smaller_multiple(n: Column, base: int) -> Column:
    return n - n % base


def clamp(n: Column, low, high) -> Column:
    return F.least(F.greatest(n, F.lit(low)), F.lit(high))


def in_range(x: Column, start: Column, end: Column) -> Column:
    """Half-open: start <= x < end."""
    return (start <= x) & (x < end)


def min_max_scaled(x: Column, least: Column, most: Column) -> Column:
    return F.coalesce(F.try_divide(most - x, most - least), F.lit(0.0))


def node_name(segment: Column, node: Column) -> Column:
    return F.format_string("{%d_%d}", segment, node)


def edge_name(from_segment: Column, from_node: Column, to_segment: Column, to_node: Column, weight: Column | None = None) -> Column:
    """``a -> b``, or ``a -[weight]-> b``."""
    if weight is None:
        return F.format_string("{%d_%d} -> {%d_%d}", from_segment, from_node, to_segment, to_node)
    return F.format_string("{%d_%d} -[%d]-> {%d_%d}", from_segment, from_node, weight, to_segment, to_node)
