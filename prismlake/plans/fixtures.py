"""Logical geometry tables read from the driver tables, and the same as SQL.

These are stand-ins: suppliers pose as cameras, parts as world points, line items as observations
and as a point cloud, embeddings as descriptors of ten images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import mat_mul, vec
from ..operators.cameras import rotation
from ..session import table

FOCAL, CX, CY, WIDTH, HEIGHT = 800.0, 320.0, 240.0, 640, 480


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_id, R, t."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("img_id"))
    r = mat_mul(rotation("x", (F.col("img_id") % 30 - 15).cast("double")), rotation("y", (F.col("img_id") * 37 % 360).cast("double")))
    return s.select("img_id", r.alias("R"), vec((F.col("img_id") % 13) * 0.01, (F.col("img_id") % 7) * 0.02, 12.0).alias("t"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pt_id, p."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("pt_id"), vec((F.col("p_size") - 25) / 8.0, (F.col("p_retailprice") - 1500) / 200.0, (k % 11 - 5) / 2.0).alias("p"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cam_id, pt_id, u, v."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cam_id"), F.col("l_partkey").alias("pt_id"), (F.col("l_quantity") * 12.8).alias("u"), (F.col("l_discount") * 4800).alias("v"))


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z and colours r, g, b."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 100).alias("z"), (F.col("l_discount") * 1000).alias("r"), (F.col("l_tax") * 2000).alias("g"), (F.col("l_quantity") * 5).alias("b"))


def parts_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pt_id, x, y, z: points with ids."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pt_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 20).alias("y"), (F.col("p_partkey") % 17).cast("double").alias("z"))


CAMERAS = """
cam_angles AS (SELECT s_suppkey AS img_id, radians((s_suppkey * 37 % 360)::DOUBLE) AS a, radians((s_suppkey % 30 - 15)::DOUBLE) AS b FROM supplier),
cameras AS (SELECT img_id, cos(a) AS r0, 0.0::DOUBLE AS r1, sin(a) AS r2, sin(b) * sin(a) AS r3, cos(b) AS r4, -sin(b) * cos(a) AS r5, -cos(b) * sin(a) AS r6, sin(b) AS r7, cos(b) * cos(a) AS r8,
  (img_id % 13) * 0.01::DOUBLE AS t0, (img_id % 7) * 0.02::DOUBLE AS t1, 12.0::DOUBLE AS t2 FROM cam_angles),
centers AS (SELECT img_id, -(r0 * t0 + r3 * t1 + r6 * t2) AS c0, -(r1 * t0 + r4 * t1 + r7 * t2) AS c1, -(r2 * t0 + r5 * t1 + r8 * t2) AS c2 FROM cameras)"""
POINTS = """
points AS (SELECT p_partkey AS pt_id, (p_size - 25) / 8.0::DOUBLE AS x, (p_retailprice - 1500) / 200.0::DOUBLE AS y, (p_partkey % 11 - 5) / 2.0::DOUBLE AS z FROM part)"""
OBSERVATIONS = """
obs AS (SELECT l_suppkey AS cam_id, l_partkey AS pt_id, l_quantity * 12.8::DOUBLE AS u, l_discount * 4800 AS v FROM lineitem)"""
CLOUD = """
cloud AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_tax * 100 AS z, l_discount * 1000 AS r, l_tax * 2000 AS g, l_quantity * 5 AS b FROM lineitem)"""
PARTS = """
pc AS (SELECT p_partkey AS pt_id, p_size::DOUBLE AS x, p_retailprice / 20 AS y, (p_partkey % 17)::DOUBLE AS z FROM part)"""
#: Camera-space coordinates of the observed points, one row an observation.
SEEN = """
seen AS (SELECT cam_id, o.pt_id, u, v, r0 * x + r1 * y + r2 * z + t0 AS xc, r3 * x + r4 * y + r5 * z + t1 AS yc, r6 * x + r7 * y + r8 * z + t2 AS zc
  FROM obs o JOIN cameras c ON c.img_id = o.cam_id JOIN points p ON p.pt_id = o.pt_id)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts) + "\n"
