"""Queries of depth maps and of images as rows of pixels: parts pose as pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import tidy, vec
from ..operators import depth as D
from ..session import table
from .camera_queries import k
from .fixtures import CAMERAS, CX, CY, FOCAL, cameras, with_
from .registry import register

PIXELS = """
px AS (SELECT p_partkey, p_partkey % 10 + 1 AS img_id, p_partkey % 640 AS u, p_partkey % 480 AS v, p_size / 5.0::DOUBLE AS d, p_partkey % 256 AS r, p_size * 5 AS g, p_partkey % 100 AS b FROM part),
q AS (SELECT p_partkey, px.img_id, r, g, b, (u - 320) * d / 800 - t0 AS x, (v - 240) * d / 800 - t1 AS y, d - t2 AS z, r0, r1, r2, r3, r4, r5, r6, r7, r8 FROM px JOIN cameras USING (img_id) WHERE d > 0 AND d < 8),
w AS (SELECT p_partkey, img_id, r, g, b, r0 * x + r3 * y + r6 * z AS wx, r1 * x + r4 * y + r7 * z AS wy, r2 * x + r5 * y + r8 * z AS wz FROM q)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", (key % 10 + 1).alias("img_id"), (key % 640).alias("u"), (key % 480).alias("v"), (F.col("p_size") / 5.0).alias("d"), (key % 256).alias("red"), (F.col("p_size") * 5).alias("green"), (key % 100).alias("blue"))
    return p.join(cameras(spark, sf_dir), "img_id")


@register("d3_depth_points", with_(CAMERAS, PIXELS) + "SELECT p_partkey, round(wx, 5) + 0.0 AS x, round(wy, 5) + 0.0 AS y, round(wz, 5) + 0.0 AS z FROM w")
def depth_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = D.depth_points(pixels(spark, sf_dir), FOCAL, CX, CY, 8.0)
    return d.select("p_partkey", *(tidy(F.col("w")[i], 5).alias(a) for i, a in enumerate("xyz")))


@register(
    "d10_dense_cloud",
    with_(CAMERAS, PIXELS)
    + """, o AS (SELECT min(wx) AS ox, min(wy) AS oy, min(wz) AS oz FROM w)
SELECT floor((wx - ox) / 2)::BIGINT AS ix, floor((wy - oy) / 2)::BIGINT AS iy, floor((wz - oz) / 2)::BIGINT AS iz, round(avg(wx), 4) + 0.0 AS x, round(avg(r / 255.0::DOUBLE), 4) + 0.0 AS red, round(avg(g / 255.0::DOUBLE), 4) + 0.0 AS green, count(*)::BIGINT AS n FROM w, o GROUP BY 1, 2, 3""",
)
def dense_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dense_cloud(pixels(spark, sf_dir), FOCAL, CX, CY, 8.0, 2.0, ("red", "green", "blue")).select("ix", "iy", "iz", *(tidy(F.col(c), 4).alias(c) for c in ("x", "red", "green")), "n")


@register("d12_patch_correlation", "SELECT l_suppkey, round(covar_pop(l_quantity, l_extendedprice / 1000) / ((stddev_pop(l_quantity) + 1e-8) * (stddev_pop(l_extendedprice / 1000) + 1e-8)), 6) + 0.0 AS ncc FROM lineitem GROUP BY 1")
def correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))
    return D.correlation(d, "l_suppkey").select("l_suppkey", tidy(F.col("ncc")).alias("ncc"))


@register("d13_view_cost", "SELECT l_orderkey, round((sum(l_discount * 10) - CASE WHEN count(*) > 2 THEN min(l_discount * 10) ELSE 0 END) / (count(*) - CASE WHEN count(*) > 2 THEN 1 ELSE 0 END), 6) + 0.0 AS cost FROM lineitem GROUP BY 1")
def view_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an order has a few line items: views of a pixel
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_discount") * 10).alias("s"))
    return d.select("l_orderkey", tidy(D.view_cost(F.col("s"))).alias("cost"))


@register(
    "d19_consistent_depth",
    """WITH px AS (SELECT p_partkey % 50 AS u, p_partkey // 50 AS v, CASE WHEN p_size > 5 THEN 8 + (p_size % 7) * 0.5::DOUBLE ELSE 0 END AS d FROM part),
src(s, a, b, c) AS (VALUES (0, 0.6::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.0::DOUBLE, 0.5::DOUBLE, 0.3::DOUBLE)),
pt AS (SELECT u, v, s, a, b, c, (u - 25) * d / 60 AS x, (v - 20) * d / 60 AS y, d AS z FROM px, src WHERE d > 0),
hit AS (SELECT u, v, s, a, b, c, round_even(60 * (x + a) / (z + c) + 25, 0)::BIGINT AS su, round_even(60 * (y + b) / (z + c) + 20, 0)::BIGINT AS sv FROM pt WHERE z + c > 0),
back AS (SELECT hit.u, hit.v, s, (su - 25) * px.d / 60 - a AS x, (sv - 20) * px.d / 60 - b AS y, px.d - c AS z FROM hit JOIN px ON px.u = su AND px.v = sv WHERE px.d > 0),
good AS (SELECT u, v, count(DISTINCT s) AS n FROM back WHERE z > 0 AND sqrt((60 * x / z + 25 - u) ** 2 + (60 * y / z + 20 - v) ** 2) < 2 GROUP BY 1, 2)
SELECT px.u, px.v, round(CASE WHEN n = 2 THEN d ELSE 0 END, 4) + 0.0 AS d FROM px LEFT JOIN good USING (u, v)""",
)
def consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, none = vec(1, 0, 0, 0, 1, 0, 0, 0, 1), vec(0, 0, 0)
    depth = F.when(F.col("p_size") > 5, 8 + (F.col("p_size") % 7) * 0.5).otherwise(0.0)
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("u"), F.floor(F.col("p_partkey") / 50).alias("v"), depth.alias("d"), one.alias("R0"), none.alias("t0"))
    views = spark.range(2).select(F.col("id").alias("src"), one.alias("R"), F.when(F.col("id") == 0, vec(0.6, 0, 0)).otherwise(vec(0, 0.5, 0.3)).alias("t"))
    return D.consistent(p, views, k(60.0, 25.0, 20.0), 60.0, 25.0, 20.0).select("u", "v", tidy(F.col("d"), 4).alias("d"))


@register(
    "n17_ssim",
    """WITH px AS (SELECT (p_partkey - 1) // 400 AS img_id, (p_partkey - 1) % 20 AS x, (p_partkey - 1) // 20 % 20 AS y, p_size / 50.0::DOUBLE AS a, (p_size / 50.0::DOUBLE + (p_partkey % 7) / 20.0::DOUBLE) / 1.3 AS b FROM part),
rows_ AS (SELECT img_id, x, y, sum(a) OVER w AS a, sum(b) OVER w AS b, sum(a * a) OVER w AS aa, sum(b * b) OVER w AS bb, sum(a * b) OVER w AS ab, count(*) OVER w AS n FROM px WINDOW w AS (PARTITION BY img_id, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
win AS (SELECT img_id, x, y, sum(a) OVER w / 49 AS a, sum(b) OVER w / 49 AS b, sum(aa) OVER w / 49 AS aa, sum(bb) OVER w / 49 AS bb, sum(ab) OVER w / 49 AS ab, sum(n) OVER w AS n FROM rows_ WINDOW w AS (PARTITION BY img_id, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT img_id, round(avg((2 * a * b + 1e-4) * (2 * 49 / 48.0 * (ab - a * b) + 9e-4) / ((a * a + b * b + 1e-4) * (49 / 48.0 * (aa - a * a + bb - b * b) + 9e-4))), 5) + 0.0 AS ssim FROM win WHERE n = 49 GROUP BY 1""",
)
def ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("p_partkey") - 1
    p = table(spark, sf_dir, "part").select(F.floor(at / 400).alias("img_id"), (at % 20).alias("x"), (F.floor(at / 20) % 20).alias("y"), (F.col("p_size") / 50.0).alias("a"), ((F.col("p_size") / 50.0 + (F.col("p_partkey") % 7) / 20.0) / 1.3).alias("b"))
    return D.structural_similarity(p).select("img_id", tidy(F.col("ssim"), 5).alias("ssim"))
