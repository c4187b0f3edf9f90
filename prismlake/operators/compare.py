"""Comparisons: a rendered image with the true one, two clouds, two camera trajectories, the range of a depth map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import norm, sub
from .cameras import center, rotation_angle
from .clouds import box_stats, neighbours
from .rendering import psnr

RGB = ("r", "g", "b")


def _unit(pixels: DataFrame, prefix: str) -> DataFrame:
    """Colours from 0 to 1 of images that may hold bytes: those with a value over 1.5 are divided by 255."""
    top = pixels.groupBy("img_id").agg(F.max(F.greatest(*RGB)).alias("_top"))
    share = lambda c: F.when(F.col("_top") > 1.5, F.col(c) / 255.0).otherwise(F.col(c).cast("double"))
    return pixels.join(top, "img_id").select("img_id", "row", "col", *(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share(c))).alias(f"{prefix}{c}") for c in RGB))


def image_errors(true: DataFrame, rendered: DataFrame) -> DataFrame:
    """img_id, row, col, error, share: the distance of a pixel's colours, and its share of the image's largest."""
    both = _unit(true, "t").join(_unit(rendered, "p"), ["img_id", "row", "col"])
    squares = sum(((F.col(f"t{c}") - F.col(f"p{c}")) ** 2 for c in RGB[1:]), (F.col("tr") - F.col("pr")) ** 2)
    d = both.select("img_id", "row", "col", F.sqrt(squares).alias("error"))
    most = d.groupBy("img_id").agg(F.max("error").alias("_most"))
    return d.join(most, "img_id").select("img_id", "row", "col", "error", (F.col("error") / (F.col("_most") + 1e-8)).alias("share"))


def image_metrics(errors: DataFrame) -> DataFrame:
    """img_id, n, mse (a channel), psnr, worst of image_errors()."""
    d = errors.groupBy("img_id").agg(F.count("*").alias("n"), (F.sum(F.col("error") * F.col("error")) / F.count("*") / 3).alias("mse"), F.max("error").alias("worst"))
    return d.select("img_id", "n", "mse", psnr(F.col("mse")).alias("psnr"), "worst")


def cloud_comparison(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """One row: points, boxes and centroids of two clouds (pt_id, x, y, z), and mean and largest distance of a sparse point from the dense cloud."""
    of = lambda d, name: (lambda s: s.select(*(F.col(c).alias(f"{name}_{c}") for c in s.columns)))(box_stats(d))
    q = sparse.select((-1 - F.col("pt_id")).alias("pt_id"), "x", "y", "z")
    base = dense.select(F.abs("pt_id").alias("pt_id"), "x", "y", "z")
    far = neighbours(base, 1, queries=q).agg(F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance"))
    return of(sparse, "sparse").crossJoin(of(dense, "dense")).crossJoin(far)


def trajectory_errors(estimated: DataFrame, true: DataFrame) -> DataFrame:
    """img_id, distance of centres, angle between rotations (degrees), of cameras (img_id, R, t) in both."""
    a = estimated.select("img_id", F.col("R").alias("_R"), center(F.col("R"), F.col("t")).alias("_c"))
    d = true.select("img_id", "R", center(F.col("R"), F.col("t")).alias("c")).join(a, "img_id")
    return d.select("img_id", norm(sub(F.col("c"), F.col("_c"))).alias("distance"), rotation_angle(F.col("R"), F.col("_R")).alias("angle"))


def path_length(cameras: DataFrame, step: int = 1) -> DataFrame:
    """length: the way from each camera's centre to that of the camera step indices on, where there is one; an equi-join, no order over all."""
    c = cameras.select("img_id", center(F.col("R"), F.col("t")).alias("c"))
    d = c.join(c.select((F.col("img_id") - step).alias("img_id"), F.col("c").alias("d")), "img_id")
    return d.agg(F.coalesce(F.sum(norm(sub(F.col("c"), F.col("d")))), F.lit(0.0)).alias("length"))


def depth_ranges(pixels: DataFrame, d: str = "d") -> DataFrame:
    """img_id, n, near, far, mean of each depth map's positive depths."""
    x = F.when(F.col(d) > 0, F.col(d))
    return pixels.groupBy("img_id").agg(F.count(x).alias("n"), F.min(x).alias("near"), F.max(x).alias("far"), F.avg(x).alias("mean"))


def depth_shares(pixels: DataFrame, d: str = "d") -> DataFrame:
    """Adds share: where in its map's range a positive depth lies, 0 to 1; null where there is none."""
    w, x = Window.partitionBy("img_id"), F.when(F.col(d) > 0, F.col(d))
    near: Column = F.min(x).over(w)
    return pixels.withColumn("share", (x - near) / (F.max(x).over(w) - near + 1e-8))
