"""Queries of reprojection, view selection, pose graphs and job status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import tidy
from ..operators import cameras as C
from ..operators import poses as G
from ..session import table
from .camera_queries import k, seen
from .fixtures import CAMERAS, OBSERVATIONS, POINTS, SEEN, cameras, with_
from .registry import register

ERRORS = """
err AS (SELECT cam_id, pt_id, sqrt((800 * xc / zc + 320 - u) ** 2 + (800 * yc / zc + 240 - v) ** 2) AS e FROM seen WHERE zc > 0)"""


@register(
    "n18_reprojection_error",
    with_(CAMERAS, POINTS, OBSERVATIONS, SEEN, ERRORS) + "SELECT cam_id, count(*)::BIGINT AS n, round(avg(e), 3) + 0.0 AS mean_error, round(median(e), 3) + 0.0 AS median_error, round(max(e), 3) + 0.0 AS max_error, round(stddev_pop(e), 3) + 0.0 AS std_error FROM err GROUP BY cam_id",
)
def reprojection_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.reprojection_errors(seen(spark, sf_dir), k())
    return G.error_stats(e, "cam_id").select("cam_id", "n", *(tidy(F.col(c), 3).alias(c) for c in ("mean_error", "median_error", "max_error", "std_error")))


@register("i10_mean_reprojection_error", with_(CAMERAS, POINTS, OBSERVATIONS, SEEN, ERRORS) + "SELECT count(*)::BIGINT AS n, round(avg(e), 3) + 0.0 AS mean_error FROM err")
def mean_reprojection_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mean_error(G.reprojection_errors(seen(spark, sf_dir), k())).select("n", tidy(F.col("mean_error"), 3).alias("mean_error"))


TWO = """
c2 AS (SELECT c.*, x.c0, x.c1, x.c2 FROM cameras c JOIN centers x USING (img_id)),
pairs AS (SELECT a.img_id AS i, b.img_id AS j, sqrt((a.c0 - b.c0) ** 2 + (a.c1 - b.c1) ** 2 + (a.c2 - b.c2) ** 2) AS base,
  degrees(acos(greatest(-1.0, least(1.0, (a.r0 * b.r0 + a.r1 * b.r1 + a.r2 * b.r2 + a.r3 * b.r3 + a.r4 * b.r4 + a.r5 * b.r5 + a.r6 * b.r6 + a.r7 * b.r7 + a.r8 * b.r8 - 1) / 2)))) AS angle
  FROM c2 a JOIN c2 b ON b.img_id > a.img_id AND b.img_id <= a.img_id + 5),
scored AS (SELECT *, CASE WHEN base < 1e-4 OR angle > 45 THEN 0.0 ELSE base / (1 + angle / 10) END AS score FROM pairs)"""


@register("d6_stereo_pairs", with_(CAMERAS, TWO) + "SELECT i, j, round(score, 4) + 0.0 AS score FROM scored WHERE score > 0")
def stereo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.stereo_pairs(cameras(spark, sf_dir)).where("score > 0").select("i", "j", tidy(F.col("score"), 4).alias("score"))


@register(
    "d21_source_views",
    with_(CAMERAS)
    + """, p AS (SELECT a.img_id AS i, b.img_id AS j, sqrt((x.c0 - y.c0) ** 2 + (x.c1 - y.c1) ** 2 + (x.c2 - y.c2) ** 2) AS base,
  degrees(acos(greatest(-1.0, least(1.0, (a.r0 * b.r0 + a.r1 * b.r1 + a.r2 * b.r2 + a.r3 * b.r3 + a.r4 * b.r4 + a.r5 * b.r5 + a.r6 * b.r6 + a.r7 * b.r7 + a.r8 * b.r8 - 1) / 2)))) AS angle
  FROM cameras a JOIN centers x USING (img_id) JOIN cameras b ON a.img_id <> b.img_id JOIN centers y ON y.img_id = b.img_id),
s AS (SELECT i, j, CASE WHEN base > 0.01 AND base < 10 AND angle < 60 THEN base / (1 + angle / 20) ELSE 0.0 END AS score FROM p)
SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(score, 9) DESC, j)::INT AS rank FROM s QUALIFY rank <= 4""",
)
def source_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.source_views(cameras(spark, sf_dir))


EDGES = """
part_of AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
edges AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, count(*)::BIGINT AS weight FROM part_of a JOIN part_of b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL)"""


#: Line items to a partition of the joins and counts of edges, so that a task's memory stays the same when the table grows.
PART_ROWS = 250_000


def edges(spark: SparkSession, sf_dir: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Suppliers that share an order. An order has few line items, so its pairs are few."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // part_rows))
    p = items.repartition(n, "l_orderkey").distinct()
    a, b = p.withColumnRenamed("l_suppkey", "src"), p.withColumnRenamed("l_suppkey", "dst")
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst").repartition(n, "src", "dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


@register(
    "g17_best_next_image",
    with_(EDGES)
    + """, bi AS (SELECT src AS img_id, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges)
SELECT img_id, count(*)::BIGINT AS links FROM bi WHERE img_id % 3 <> 0 AND other % 3 = 0 GROUP BY 1""",
)
def best_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    registered = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("img_id"))
    return G.next_images(e, registered)


@register("g13_pose_graph_degrees", with_(EDGES) + ", bi AS (SELECT src AS img_id, weight FROM edges UNION ALL SELECT dst, weight FROM edges) SELECT img_id, count(*)::BIGINT AS degree, sum(weight)::BIGINT AS weight FROM bi GROUP BY 1")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.symmetric(edges(spark, sf_dir), "weight").groupBy(F.col("src").alias("img_id")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))


@register("a1_latest_status", "SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY 1")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), "event_id")
    return G.latest(e, "job_id", ["updated_at", "event_id"]).select("job_id", "status", "updated_at")


@register("l5_split_by_index", "SELECT CASE WHEN s_suppkey < n * 0.7 THEN 'train' WHEN s_suppkey < n * 0.85 THEN 'val' ELSE 'test' END AS split, count(*)::BIGINT AS n FROM supplier, (SELECT count(*) AS n FROM supplier) GROUP BY 1")
def split_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    total = s.agg(F.count("*").alias("total"))
    part = F.when(F.col("s_suppkey") < F.col("total") * 0.7, "train").when(F.col("s_suppkey") < F.col("total") * 0.85, "val").otherwise("test")
    return s.crossJoin(F.broadcast(total)).groupBy(part.alias("split")).agg(F.count("*").alias("n"))


@register(
    "i12_camera_frustums",
    with_(CAMERAS) + "SELECT img_id, k::INT AS corner, round(c0 + r0 * x + r3 * y + r6 * 0.5, 5) + 0.0 AS wx, round(c1 + r1 * x + r4 * y + r7 * 0.5, 5) + 0.0 AS wy FROM cameras JOIN centers USING (img_id), (VALUES (0, -0.2, -0.15), (1, 0.2, -0.15), (2, 0.2, 0.15), (3, -0.2, 0.15)) f(k, x, y)",
)
def frustums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.frustum_corners(cameras(spark, sf_dir), 0.2, 0.15, 0.5).select("img_id", "corner", tidy(F.col("w")[0], 5).alias("wx"), tidy(F.col("w")[1], 5).alias("wy"))
