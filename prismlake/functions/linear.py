"""3-vectors and 3x3 matrices as array<double> columns (row-major), in built-in expressions only.

Each result names its arguments many times. Between two products give the first a column of its own
(withColumn), or the expression grows with every step as a power.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(*parts: Column | float) -> Column:
    return F.array(*((p if isinstance(p, Column) else F.lit(p)).cast("double") for p in parts))


def dot(a: Column, b: Column, n: int = 3) -> Column:
    return sum((a[k] * b[k] for k in range(1, n)), a[0] * b[0])


def cross(a: Column, b: Column) -> Column:
    return vec(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def add(a: Column, b: Column) -> Column:
    return vec(*(a[k] + b[k] for k in range(3)))


def sub(a: Column, b: Column) -> Column:
    return vec(*(a[k] - b[k] for k in range(3)))


def scale(a: Column, s: Column | float) -> Column:
    return vec(*(a[k] * s for k in range(3)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mat_vec(m: Column, v: Column) -> Column:
    return vec(*(m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)))


def mat_t_vec(m: Column, v: Column) -> Column:
    return vec(*(m[i] * v[0] + m[3 + i] * v[1] + m[6 + i] * v[2] for i in range(3)))


def mat_mul(a: Column, b: Column) -> Column:
    return vec(*(sum((a[3 * i + k] * b[3 * k + j] for k in (1, 2)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def transpose(m: Column) -> Column:
    return vec(*(m[3 * j + i] for i in range(3) for j in range(3)))


def det(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero: what reports and comparisons want."""
    return F.round(c, digits) + F.lit(0.0)
