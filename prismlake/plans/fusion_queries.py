"""Queries of depth fusion: every camera sees a ball about the origin, whose depths are known in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import dot, tidy, vec
from ..operators import fusion as U
from ..operators import meshes as M
from ..session import materialize
from .fixtures import CAMERAS, cameras, with_
from .registry import register

#: Pixels along a side, focal length, centre, the ball's radius, and the volume's voxel and bound.
GRID, BALL, VOXEL, TRUNC = 40, 2.0, 0.25, 0.75
OPTICS = (80.0, 19.5, 19.5)

DEPTHS = """
rays AS (SELECT img_id, u, v, (u - 19.5) / 80 AS a, (v - 19.5) / 80 AS b, t0, t1, t2 FROM cameras, range(0, 40) x(u), range(0, 40) y(v)),
roots AS (SELECT *, a * t0 + b * t1 + t2 AS m, a * a + b * b + 1 AS n FROM rays),
depths AS (SELECT img_id, u, v, (m - sqrt(m * m - n * (t0 * t0 + t1 * t1 + t2 * t2 - 4))) / n AS d FROM roots WHERE m * m - n * (t0 * t0 + t1 * t1 + t2 * t2 - 4) >= 0),
along AS (SELECT c.*, (u - 19.5) * (d + e) / 80 - t0 AS x, (v - 19.5) * (d + e) / 80 - t1 AS y, (d + e) - t2 AS z FROM depths JOIN cameras c USING (img_id), (VALUES (-0.75::DOUBLE), (0.0::DOUBLE), (0.75::DOUBLE)) s(e)),
blocks AS (SELECT DISTINCT img_id, floor((r0 * x + r3 * y + r6 * z) / 2)::BIGINT AS bx, floor((r1 * x + r4 * y + r7 * z) / 2)::BIGINT AS byy, floor((r2 * x + r5 * y + r8 * z) / 2)::BIGINT AS bz FROM along),
voxels AS (SELECT img_id, bx * 8 + i % 8 AS ix, byy * 8 + i // 8 % 8 AS iy, bz * 8 + i // 64 AS iz FROM blocks, range(0, 512) g(i)),
placed AS (SELECT img_id, ix, iy, iz, r0 * ix * 0.25 + r1 * iy * 0.25 + r2 * iz * 0.25 + t0 AS x, r3 * ix * 0.25 + r4 * iy * 0.25 + r5 * iz * 0.25 + t1 AS y, r6 * ix * 0.25 + r7 * iy * 0.25 + r8 * iz * 0.25 + t2 AS z FROM voxels JOIN cameras USING (img_id)),
asked AS (SELECT img_id, ix, iy, iz, z, floor(x / z * 80 + 19.5 + 0.5)::BIGINT AS u, floor(y / z * 80 + 19.5 + 0.5)::BIGINT AS v FROM placed WHERE z > 0),
volume AS (SELECT ix, iy, iz, count(*)::BIGINT AS weight, sum(round(least(1.0, (d - z) / 0.75) * 1048576)::BIGINT)::DOUBLE / count(*) / 1048576 AS tsdf FROM asked JOIN depths USING (img_id, u, v) WHERE d - z >= -0.75 GROUP BY ALL)"""
CROSSINGS = """
ways AS (SELECT m, m % 2 AS dx, m // 2 % 2 AS dy, m // 4 AS dz FROM range(1, 8) w(m)),
crossings AS (SELECT a.ix, a.iy, a.iz, m, dx, dy, dz, a.tsdf / (a.tsdf - b.tsdf) AS s FROM volume a, ways JOIN volume b ON b.ix = a.ix + dx AND b.iy = a.iy + dy AND b.iz = a.iz + dz WHERE (a.tsdf < 0) <> (b.tsdf < 0))"""
CUBES = """
corners AS (SELECT ix - c % 2 AS ix, iy - c // 2 % 2 AS iy, iz - c // 4 AS iz, c, tsdf < 0 AS inside FROM volume, range(0, 8) k(c)),
cubes AS (SELECT ix, iy, iz, list(inside ORDER BY c) AS s FROM corners GROUP BY ALL HAVING count(*) = 8),
tets AS (SELECT s[1]::INT + s[1 + (1 << p)]::INT + s[1 + (1 << p) + (1 << q)]::INT + s[8]::INT AS n FROM cubes, range(0, 3) a(p), range(0, 3) b(q) WHERE p <> q)"""


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, u, v, d of the pixels that meet the ball."""
    # a small file is one part, and its rows become many
    d = cameras(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "img_id").withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    q = vec((F.col("u") - OPTICS[1]) / OPTICS[0], (F.col("v") - OPTICS[2]) / OPTICS[0], 1)
    d = d.withColumn("m", dot(q, F.col("t"))).withColumn("n", dot(q, q)).withColumn("c", dot(F.col("t"), F.col("t")) - BALL**2)
    d = d.where("m * m - n * c >= 0")
    return d.select("img_id", "u", "v", ((F.col("m") - F.sqrt(F.col("m") * F.col("m") - F.col("n") * F.col("c"))) / F.col("n")).alias("d"))


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.integrate(depths(spark, sf_dir), cameras(spark, sf_dir), OPTICS, VOXEL, TRUNC, 100.0)


@register("d23_tsdf_volume", with_(CAMERAS, DEPTHS) + "SELECT ix, iy, iz, weight, round(tsdf, 4) + 0.0 AS tsdf FROM volume")
def tsdf_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume(spark, sf_dir).select("ix", "iy", "iz", "weight", tidy(F.col("tsdf"), 4).alias("tsdf"))


@register("d24_tsdf_points", with_(CAMERAS, DEPTHS, CROSSINGS) + "SELECT round((ix + dx * s) * 0.25, 3) + 0.0 AS x, round((iy + dy * s) * 0.25, 3) + 0.0 AS y, round((iz + dz * s) * 0.25, 3) + 0.0 AS z FROM crossings WHERE m IN (1, 2, 4)")
def tsdf_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.extract_points(materialize(volume(spark, sf_dir), "volume"), VOXEL).select(*(tidy(F.col(a), 3).alias(a) for a in "xyz"))


@register(
    "d25_tsdf_mesh",
    with_(CAMERAS, DEPTHS, CROSSINGS, CUBES) + """, bound AS (SELECT DISTINCT c.ix, c.iy, c.iz, c.m FROM crossings c, range(0, 8) k(o) JOIN cubes b ON b.ix = c.ix - o % 2 AND b.iy = c.iy - o // 2 % 2 AND b.iz = c.iz - o // 4 WHERE ((o & c.m) = 0))
SELECT (SELECT sum(CASE n WHEN 2 THEN 2 ELSE 1 END) FROM tets WHERE n BETWEEN 1 AND 3)::BIGINT AS n_faces, (SELECT count(*) FROM bound)::BIGINT AS n_vertices""",
)
def tsdf_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces, vertices = U.extract_mesh(volume(spark, sf_dir), VOXEL)
    return M.quality(faces, vertices).select("n_faces", "n_vertices")
