"""Queries of comparisons, of cameras of six numbers, of normalisations and of the best stereo pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import mat_mul, tidy, vec
from ..operators import cameras as C
from ..operators import compare as X
from ..operators import poses as G
from ..session import materialize, table
from .camera_queries import k
from .depth_queries import PIXELS, pixels
from .fixtures import CAMERAS, OBSERVATIONS, PARTS, POINTS, SEEN, cameras, observations, parts_cloud, points, with_
from .pose_queries import TWO
from .registry import register

IMAGES = """
im AS (SELECT p_partkey % 10 AS img_id, p_partkey AS row, (p_size * 5)::DOUBLE AS tr, (p_partkey % 256)::DOUBLE AS tg, (p_partkey % 100)::DOUBLE AS tb, (p_size / 50.0)::DOUBLE AS pr, (p_partkey % 200 / 200.0)::DOUBLE AS pg, 0.5::DOUBLE AS pb FROM part),
top AS (SELECT img_id, max(greatest(tr, tg, tb)) AS a, max(greatest(pr, pg, pb)) AS b FROM im GROUP BY 1),
er AS (SELECT im.img_id, row, sqrt((least(1.0, tr / s) - least(1.0, pr / q)) ** 2 + (least(1.0, tg / s) - least(1.0, pg / q)) ** 2 + (least(1.0, tb / s) - least(1.0, pb / q)) ** 2) AS e FROM im JOIN (SELECT img_id, CASE WHEN a > 1.5 THEN 255.0 ELSE 1.0 END AS s, CASE WHEN b > 1.5 THEN 255.0 ELSE 1.0 END AS q FROM top) USING (img_id))"""


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key, p = F.col("p_partkey"), table(spark, sf_dir, "part")
    place = [(key % 10).alias("img_id"), key.alias("row"), F.lit(0).alias("col")]
    return p.select(*place, (F.col("p_size") * 5).alias("r"), (key % 256).alias("g"), (key % 100).alias("b")), p.select(*place, (F.col("p_size") / 50.0).alias("r"), (key % 200 / 200.0).alias("g"), F.lit(0.5).alias("b"))


@register("v2_image_errors", with_(IMAGES) + "SELECT img_id, row, round(e, 5) + 0.0 AS error, round(e / (max(e) OVER (PARTITION BY img_id) + 1e-8), 5) + 0.0 AS share FROM er")
def image_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.image_errors(*_images(spark, sf_dir)).select("img_id", "row", tidy(F.col("error"), 5).alias("error"), tidy(F.col("share"), 5).alias("share"))


@register("v2_image_metrics", with_(IMAGES) + "SELECT img_id, count(*)::BIGINT AS n, round(-10 * log10(sum(e * e) / count(*) / 3), 4) + 0.0 AS psnr, round(max(e), 5) + 0.0 AS worst FROM er GROUP BY 1")
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.image_metrics(X.image_errors(*_images(spark, sf_dir))).select("img_id", "n", tidy(F.col("psnr"), 4).alias("psnr"), tidy(F.col("worst"), 5).alias("worst"))


@register(
    "v4_cloud_comparison",
    with_(PARTS)
    + """, q AS (SELECT s_suppkey AS id, (s_suppkey % 50)::DOUBLE AS x, 45 + s_suppkey % 55::DOUBLE AS y, (s_suppkey % 17)::DOUBLE AS z FROM supplier),
d AS (SELECT id, min(sqrt((q.x - pc.x) * (q.x - pc.x) + (q.y - pc.y) * (q.y - pc.y) + (q.z - pc.z) * (q.z - pc.z))) AS d FROM q, pc GROUP BY 1)
SELECT (SELECT count(*) FROM q)::BIGINT AS sparse_n, (SELECT count(*) FROM pc)::BIGINT AS dense_n, (SELECT round(avg(d), 5) FROM d) + 0.0 AS mean_distance, (SELECT round(max(d), 5) FROM d) + 0.0 AS max_distance, (SELECT round(avg(y), 5) FROM pc) + 0.0 AS dense_mean_y""",
)
def cloud_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    q = table(spark, sf_dir, "supplier").select(s.alias("pt_id"), (s % 50).cast("double").alias("x"), (45 + s % 55).cast("double").alias("y"), (s % 17).cast("double").alias("z"))
    return X.cloud_comparison(q, parts_cloud(spark, sf_dir)).select("sparse_n", "dense_n", *(tidy(F.col(c), 5).alias(c) for c in ("mean_distance", "max_distance", "dense_mean_y")))


@register("v5_trajectory_errors", with_(CAMERAS) + "SELECT img_id, round(sqrt(0.01 + (img_id % 3) * (img_id % 3) / 100.0), 5) + 0.0 AS distance, round((img_id % 20)::DOUBLE, 4) + 0.0 AS angle FROM cameras")
def trajectory_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras against themselves, turned about their own axis and moved by known ways."""
    d = cameras(spark, sf_dir)
    off = d.withColumn("c", C.center(F.col("R"), F.col("t"))).withColumn("r2", mat_mul(C.rotation("z", (F.col("img_id") % 20).cast("double")), F.col("R")))
    moved = vec(F.col("c")[0] + 0.1, F.col("c")[1], F.col("c")[2] - (F.col("img_id") % 3) / 10.0)
    off = off.withColumn("c2", moved).select("img_id", F.col("r2").alias("R"), vec(*(-(F.col("r2")[3 * i] * F.col("c2")[0] + F.col("r2")[3 * i + 1] * F.col("c2")[1] + F.col("r2")[3 * i + 2] * F.col("c2")[2]) for i in range(3))).alias("t"))
    return X.trajectory_errors(off, d).select("img_id", tidy(F.col("distance"), 5).alias("distance"), tidy(F.col("angle"), 4).alias("angle"))


@register("v5_path_length", with_(CAMERAS) + "SELECT round(coalesce(sum(sqrt((a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2)), 0), 4) + 0.0 AS length FROM centers a JOIN centers b ON b.img_id = a.img_id + 1")
def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.path_length(cameras(spark, sf_dir)).select(tidy(F.col("length"), 4).alias("length"))


@register("v9_depth_ranges", with_(CAMERAS, PIXELS) + "SELECT img_id, count(*)::BIGINT AS n, min(d) + 0.0 AS near, max(d) + 0.0 AS far, round(avg(d), 6) + 0.0 AS mean FROM px JOIN cameras USING (img_id) WHERE d > 0 GROUP BY 1")
def depth_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.depth_ranges(pixels(spark, sf_dir)).select("img_id", "n", (F.col("near") + 0.0).alias("near"), (F.col("far") + 0.0).alias("far"), tidy(F.col("mean")).alias("mean"))


@register("c33_project_world", with_(CAMERAS, POINTS, OBSERVATIONS, SEEN) + "SELECT cam_id, pt_id, round(800 * xc / zc + 320, 3) + 0.0 AS pu, round(800 * yc / zc + 240, 3) + 0.0 AS pv FROM seen WHERE zc > 0")
def project_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras as axis-angle vectors and shifts, made once a camera."""
    cams = materialize(cameras(spark, sf_dir), "cameras")
    six = materialize(cams.withColumn("w", C.matrix_axis_angle(F.col("R"))).select(F.col("img_id").alias("cam_id"), F.concat("w", "t").alias("camera")), "six")
    d = observations(spark, sf_dir).select("cam_id", "pt_id").join(points(spark, sf_dir), "pt_id").join(six, "cam_id")
    d = C.project_world(d, k()).where("u IS NOT NULL")
    return d.select("cam_id", "pt_id", tidy(F.col("u"), 3).alias("pu"), tidy(F.col("v"), 3).alias("pv"))


@register("c8_normalizations", with_(OBSERVATIONS) + """, m AS (SELECT cam_id, avg(u) AS mu, avg(v) AS mv FROM obs GROUP BY 1),
s AS (SELECT cam_id, sqrt(2.0) / (avg(sqrt((u - mu) ** 2 + (v - mv) ** 2)) + 1e-8) AS s FROM obs JOIN m USING (cam_id) GROUP BY 1)
SELECT cam_id, round(s, 6) + 0.0 AS t0, round(-s * mu, 5) + 0.0 AS t2, round(-s * mv, 5) + 0.0 AS t5 FROM s JOIN m USING (cam_id)""")
def normalizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = C.normalizations(observations(spark, sf_dir), "u", "v", by=("cam_id",))
    return t.select("cam_id", tidy(F.col("T")[0]).alias("t0"), tidy(F.col("T")[2], 5).alias("t2"), tidy(F.col("T")[5], 5).alias("t5"))


@register("d6_best_stereo_pairs", with_(CAMERAS, TWO) + "SELECT i, j, round(score, 4) + 0.0 AS score FROM scored WHERE score > 0 ORDER BY scored.score DESC, i, j LIMIT 20")
def best_stereo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_stereo_pairs(cameras(spark, sf_dir), 20).select("i", "j", tidy(F.col("score"), 4).alias("score"))
