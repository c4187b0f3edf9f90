"""Queries of point clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import tidy
from ..operators import clouds as P
from .fixtures import CLOUD, PARTS, cloud, parts_cloud, with_
from .registry import register


@register(
    "d9_voxel_downsample",
    with_(CLOUD)
    + """SELECT floor((x - ox) / 5)::BIGINT AS ix, floor((y - oy) / 5)::BIGINT AS iy, floor((z - oz) / 5)::BIGINT AS iz, round(avg(x), 4) + 0.0 AS x, round(avg(y), 4) + 0.0 AS y, round(avg(r), 4) + 0.0 AS r, count(*)::BIGINT AS n
FROM cloud, (SELECT min(x) AS ox, min(y) AS oy, min(z) AS oz FROM cloud) GROUP BY 1, 2, 3""",
)
def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.voxel_downsample(cloud(spark, sf_dir), 5.0).select("ix", "iy", "iz", *(tidy(F.col(c), 4).alias(c) for c in "xyr"), "n")


@register("a15_cloud_stats", with_(CLOUD) + "SELECT count(*)::BIGINT AS n, round(min(x), 4) AS min_x, round(max(y), 4) AS max_y, round(avg(z), 4) + 0.0 AS mean_z, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2), 4) AS diagonal FROM cloud")
def cloud_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.box_stats(cloud(spark, sf_dir)).select("n", *(tidy(F.col(c), 4).alias(c) for c in ("min_x", "max_y", "mean_z", "diagonal")))


@register(
    "i11_remove_outliers",
    with_(CLOUD)
    + """, s AS (SELECT median(x) AS mx, stddev_pop(x) AS sx, median(y) AS my, stddev_pop(y) AS sy, median(z) AS mz, stddev_pop(z) AS sz FROM cloud)
SELECT x::BIGINT AS quantity, count(*)::BIGINT AS n FROM cloud, s WHERE abs(x - mx) < 1.5 * (sx + 1e-9) AND abs(y - my) < 1.5 * (sy + 1e-9) AND abs(z - mz) < 1.5 * (sz + 1e-9) GROUP BY 1""",
)
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.remove_outliers(cloud(spark, sf_dir), spread=1.5).groupBy(F.col("x").cast("long").alias("quantity")).agg(F.count("*").alias("n"))


NEAR = """
near AS (SELECT a.pt_id, b.pt_id AS nn_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM pc a JOIN pc b ON a.pt_id <> b.pt_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pt_id ORDER BY d, nn_id) AS rank FROM near)"""


@register("h1_nearest_points", with_(PARTS, NEAR) + "SELECT pt_id, rank::INT AS rank, round(d, 6) + 0.0 AS d FROM ranked WHERE rank <= 5")
def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.neighbours(parts_cloud(spark, sf_dir), 5).select("pt_id", "rank", tidy(F.col("d")).alias("d"))


@register(
    "d8_statistical_outliers",
    with_(PARTS, NEAR) + ", m AS (SELECT pt_id, avg(d) AS md FROM ranked WHERE rank <= 20 GROUP BY 1) SELECT pt_id, round(md, 6) + 0.0 AS mean_distance, md < (SELECT avg(md) + 2 * stddev_pop(md) FROM m) AS keep FROM m",
)
def statistical_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.statistical_outliers(parts_cloud(spark, sf_dir), 20, 2.0).select("pt_id", tidy(F.col("mean_distance")).alias("mean_distance"), "keep")


@register(
    "r5_normalize_scene",
    with_(CLOUD)
    + """, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM cloud)
SELECT round(any_value(cx), 4) + 0.0 AS cx, round(any_value(cy), 4) + 0.0 AS cy, round(quantile_cont(sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2), 0.9), 4) AS scale FROM cloud, c""",
)
def scene_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scene_scale(cloud(spark, sf_dir)).select(*(tidy(F.col(c), 4).alias(c) for c in ("cx", "cy", "scale")))
