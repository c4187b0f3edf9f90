"""Queries of rays, encodings, volume rendering and image metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.linear import tidy, vec
from ..operators import rendering as N
from ..operators.depth import disparity_to_depth
from ..session import table
from .fixtures import CX, CY, FOCAL, observations, with_
from .registry import register

DIRECTIONS = """
px AS (SELECT l_suppkey AS cam_id, (l_quantity * 12.8 - 320) / 800 AS a, (l_discount * 4800 - 240) / 800 AS b FROM lineitem),
dirs AS (SELECT cam_id, a / sqrt(a * a + b * b + 1) AS dx, b / sqrt(a * a + b * b + 1) AS dy, 1 / sqrt(a * a + b * b + 1) AS dz FROM px)"""


def directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("cam_id", N.pixel_direction(F.col("u"), F.col("v"), FOCAL, CX, CY).alias("d"))


@register("r1_pixel_rays", with_(DIRECTIONS) + "SELECT cam_id, count(*)::BIGINT AS n, round(avg(dx), 6) + 0.0 AS dx, round(avg(dy), 6) + 0.0 AS dy, round(avg(dz), 6) + 0.0 AS dz FROM dirs GROUP BY 1")
def pixel_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directions(spark, sf_dir).groupBy("cam_id").agg(F.count("*").alias("n"), *(tidy(F.avg(F.col("d")[i])).alias(f"d{a}") for i, a in enumerate("xyz")))


@register(
    "r14_ray_sphere",
    with_(DIRECTIONS)
    + """, q AS (SELECT cam_id, -(dx * 0.1 + dz * 4) AS b, 0.01 + 16 - 1.0 AS c FROM dirs)
SELECT cam_id, count(*) FILTER (b * b - c >= 0)::BIGINT AS hits, round(avg(CASE WHEN b * b - c >= 0 THEN -b - sqrt(b * b - c) END), 5) + 0.0 AS mean_t FROM q GROUP BY 1""",
)
def ray_sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = N.sphere_hit(vec(0, 0, 0), F.col("d"), vec(0.1, 0, 4), 1.0)
    return directions(spark, sf_dir).withColumn("t", t).groupBy("cam_id").agg(F.count_if(F.col("t") > 0).alias("hits"), tidy(F.avg(F.when(F.col("t") > 0, F.col("t"))), 5).alias("mean_t"))


@register(
    "r13_ray_box",
    with_(DIRECTIONS)
    + """, s AS (SELECT cam_id, greatest(least(-1 / nx, 1 / nx), least(-0.5 / ny, 0.5 / ny), 3 / dz) AS enter, least(greatest(-1 / nx, 1 / nx), greatest(-0.5 / ny, 0.5 / ny), 5 / dz) AS leave
  FROM (SELECT cam_id, dz, CASE WHEN abs(dx) < 1e-12 THEN 1e-12 ELSE dx END AS nx, CASE WHEN abs(dy) < 1e-12 THEN 1e-12 ELSE dy END AS ny FROM dirs))
SELECT cam_id, count(*) FILTER (leave >= greatest(enter, 0.0))::BIGINT AS hits, round(avg(CASE WHEN leave >= greatest(enter, 0.0) THEN enter END), 5) + 0.0 AS mean_t FROM s GROUP BY 1""",
)
def ray_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = N.box_hit(vec(0, 0, 0), F.col("d"), vec(-1, -0.5, 3), vec(1, 0.5, 5))
    return directions(spark, sf_dir).withColumn("t", t).groupBy("cam_id").agg(F.count_if(F.col("t") > 0).alias("hits"), tidy(F.avg(F.when(F.col("t") > 0, F.col("t"))), 5).alias("mean_t"))


@register(
    "n1_positional_encoding",
    "SELECT p_partkey, round(sin(x), 6) + 0.0 AS s0, round(cos(x * 8), 6) + 0.0 AS c3, 9 AS width, round(sin(x * 4) * exp(-0.5 * 16 * 0.01), 6) + 0.0 AS i2 FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part)",
)
def encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size") / 50.0
    d = table(spark, sf_dir, "part").select("p_partkey", N.encode(x, 4).alias("e"), N.encode_integrated(x, F.lit(0.01), 4).alias("i"))
    return d.select("p_partkey", tidy(F.col("e")[1]).alias("s0"), tidy(F.col("e")[8]).alias("c3"), F.size("e").alias("width"), tidy(F.col("i")[2]).alias("i2"))


SAMPLES = """
samples AS (SELECT o_orderkey AS ray_id, o_orderkey % 7 + s * 0.5 AS z, s, (o_totalprice % 10) / 10 * (s % 3) AS sigma, (o_orderkey % 11) / 11.0::DOUBLE AS r, s / 8.0::DOUBLE AS g FROM orders, range(0, 8) t(s)),
steps AS (SELECT *, 1 - exp(-greatest(sigma, 0.0) * coalesce(lead(z) OVER (PARTITION BY ray_id ORDER BY z) - z, 1e10)) AS alpha FROM samples),
lit AS (SELECT *, alpha * exp(coalesce(sum(ln(1 - alpha + 1e-10)) OVER (PARTITION BY ray_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS w FROM steps)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ray_id"), "o_totalprice", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("s"))
    return o.select("ray_id", (F.col("ray_id") % 7 + F.col("s") * 0.5).alias("z"), ((F.col("o_totalprice") % 10) / 10 * (F.col("s") % 3)).alias("sigma"), ((F.col("ray_id") % 11) / 11.0).alias("r"), (F.col("s") / 8.0).alias("g"))


@register("n10_volume_render", with_(SAMPLES) + "SELECT ray_id, round(sum(w * r) + 1 - sum(w), 5) + 0.0 AS r, round(sum(w * g) + 1 - sum(w), 5) + 0.0 AS g, round(sum(w * z), 5) + 0.0 AS depth, round(sum(w), 5) + 0.0 AS acc FROM lit GROUP BY 1")
def volume_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = N.composite(samples(spark, sf_dir), values=("r", "g"), white=True)
    return d.select("ray_id", *(tidy(F.col(c), 5).alias(c) for c in ("r", "g", "depth", "acc")))


@register("n8_sample_depths", "SELECT o_orderkey AS ray_id, round(1 + (o_orderkey % 7 + 1) * 3 / 15.0, 6) + 0.0 AS z3, round(2 + o_orderkey % 7, 6)::DOUBLE AS last_z, 16 AS n FROM orders")
def sample_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = N.stratified_depths(F.lit(1.0), 2.0 + F.col("o_orderkey") % 7, 16)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ray_id"), z.alias("z")).select("ray_id", tidy(F.col("z")[3]).alias("z3"), tidy(F.col("z")[15]).alias("last_z"), F.size("z").alias("n"))


@register(
    "n9_inverse_cdf",
    """WITH w AS (SELECT o_orderkey AS ray_id, (o_orderkey % 5) + 1e-5 AS w0, (o_orderkey % 3) + 1e-5 AS w1, 1 + 1e-5 AS w2, (o_orderkey % 97) / 97.0::DOUBLE AS u FROM orders),
c AS (SELECT *, w0 / (w0 + w1 + w2) AS c1, w0 / (w0 + w1 + w2) + w1 / (w0 + w1 + w2) AS c2 FROM w)
SELECT ray_id, round(CASE WHEN u < c1 THEN 2 + u / (CASE WHEN c1 < 1e-5 THEN 1 ELSE c1 END) WHEN u < c2 THEN 3 + (u - c1) / (CASE WHEN c2 - c1 < 1e-5 THEN 1 ELSE c2 - c1 END) ELSE 4 + (u - c2) / (1 - c2) END, 4) + 0.0 AS z FROM c""",
)
def inverse_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ray_id"))
    z = N.inverse_cdf(vec(2, 3, 4, 5), vec(F.col("ray_id") % 5, F.col("ray_id") % 3, 1), (F.col("ray_id") % 97) / 97.0)
    return o.select("ray_id", tidy(z, 4).alias("z"))


@register("n16_psnr", "SELECT l_suppkey AS cam_id, round(-10 * log10(avg((l_discount - l_tax) ** 2)), 5) + 0.0 AS psnr FROM lineitem GROUP BY 1")
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    mse = F.avg((F.col("l_discount") - F.col("l_tax")) ** 2)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cam_id")).agg(mse.alias("mse")).select("cam_id", tidy(N.psnr(F.col("mse")), 5).alias("psnr"))


@register(
    "v6_training_curve",
    "SELECT user_id, event_id, round(m, 5) + 0.0 AS smooth FROM (SELECT user_id, event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5",
)
def training_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    d = table(spark, sf_dir, "events").select("user_id", "event_id", F.avg("value").over(w).alias("m"), F.count("*").over(w).alias("n"))
    return d.where("n = 5").select("user_id", "event_id", tidy(F.col("m"), 5).alias("smooth"))


@register(
    "v9_depth_histogram",
    "SELECT least(floor((l_extendedprice - lo) / ((hi - lo) / 50))::INT, 49) AS bin, count(*)::BIGINT AS n FROM lineitem, (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem WHERE l_extendedprice > 0) WHERE l_extendedprice > 0 GROUP BY 1",
)
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").where("l_extendedprice > 0").select(F.col("l_extendedprice").alias("d"))
    ends = d.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return d.crossJoin(F.broadcast(ends)).groupBy(F.least(F.floor((F.col("d") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 50)).cast("int"), F.lit(49)).alias("bin")).agg(F.count("*").alias("n"))


@register("d2_disparity_to_depth", "SELECT l_suppkey AS cam_id, round(sum(CASE WHEN l_discount > 0 THEN 0.5 * 800 / (l_discount * 100) ELSE 0 END), 2) + 0.0 AS depth_sum, count(*) FILTER (l_discount > 0)::BIGINT AS valid FROM lineitem GROUP BY 1")
def disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount") * 100
    depth = disparity_to_depth(d, FOCAL, 0.5)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cam_id")).agg(tidy(F.sum(depth), 2).alias("depth_sum"), F.count_if(d > 0).alias("valid"))
