"""Queries of oriented normals and of signed distances: parts pose as points, their normals point away from the middle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import norm, scale, tidy, vec
from ..operators import clouds as P
from ..operators import scenes as S
from ..operators import surfaces as U
from .fixtures import PARTS, parts_cloud, with_
from .registry import register

CELLS = 10


@register("h2_oriented_normals")
def oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals by their neighbours' spread, turned to agree along the spanning forest."""
    p = parts_cloud(spark, sf_dir)
    near = P.neighbours(p, 10)
    n = U.orient_normals(S.normals(p, near), near)
    return n.select("pt_id", *(tidy(F.col("n")[i], 4).alias(a) for i, a in enumerate(("nx", "ny", "nz"))))


def _blur(name: str, source: str, axis: str) -> str:
    rest = ", ".join(a for a in ("ix", "iy", "iz") if a != axis)
    return f"""{name} AS (SELECT {rest}, {axis}, sum(s * w) AS s FROM (SELECT {rest}, m - o AS {axis}, s, w FROM (SELECT {rest}, unnest([{axis}, -{axis} - 1, 19 - {axis}]) AS m, s FROM {source}), kernel) WHERE {axis} BETWEEN 0 AND 9 GROUP BY ALL)"""


@register(
    "h4_signed_distances",
    with_(PARTS)
    + """, p AS (SELECT pt_id, x, y, z, (x - 25) / r AS nx, (y - 70) / r AS ny, (z - 8) / r AS nz FROM (SELECT *, sqrt((x - 25) ** 2 + (y - 70) ** 2 + (z - 8) ** 2) + 1e-9 AS r FROM pc)),
box AS (SELECT min(x) - 0.1 AS lx, min(y) - 0.1 AS ly, min(z) - 0.1 AS lz, (max(x) - min(x) + 0.2) / 9 AS sx, (max(y) - min(y) + 0.2) / 9 AS sy, (max(z) - min(z) + 0.2) / 9 AS sz FROM pc),
g AS (SELECT a.i AS ix, b.i AS iy, c.i AS iz, lx + a.i * sx AS x, ly + b.i * sy AS y, lz + c.i * sz AS z, sx * 9 / 10 AS h FROM box, range(0, 10) a(i), range(0, 10) b(i), range(0, 10) c(i)),
d AS (SELECT ix, iy, iz, h, (g.x - p.x) * nx + (g.y - p.y) * ny + (g.z - p.z) * nz AS s, sqrt((g.x - p.x) * (g.x - p.x) + (g.y - p.y) * (g.y - p.y) + (g.z - p.z) * (g.z - p.z)) AS d, pt_id FROM g, p QUALIFY row_number() OVER (PARTITION BY ix, iy, iz ORDER BY d, pt_id) <= 10),
f AS (SELECT ix, iy, iz, coalesce(sum(exp(-d * d / (2 * h * h)) * s) FILTER (d >= 1e-8), 0) / (coalesce(sum(exp(-d * d / (2 * h * h))) FILTER (d >= 1e-8), 0) + 1e-8) AS s FROM d GROUP BY ALL),
bell AS (SELECT o, exp(-0.5 * o * o) AS w FROM range(-4, 5) k(o)),
kernel AS (SELECT o, w / (SELECT sum(w) FROM bell) AS w FROM bell),
"""
    + ",\n".join((_blur("f1", "f", "ix"), _blur("f2", "f1", "iy"), _blur("f3", "f2", "iz")))
    + " SELECT ix, iy, iz, round(s, 4) + 0.0 AS sdf FROM f3",
)
def signed_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts_cloud(spark, sf_dir)
    away = vec(F.col("x") - 25, F.col("y") - 70, F.col("z") - 8)
    p = p.withColumn("n", scale(away, 1 / (norm(away) + 1e-9)))
    grid = U.blurred(U.signed_distances(p, CELLS), CELLS)
    return grid.select("ix", "iy", "iz", tidy(F.col("tsdf"), 4).alias("sdf"))
