"""Depth maps as rows of pixels: points, correlation of patches, consistency between views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import vec
from .cameras import camera_to_world, project, world_to_camera
from .clouds import voxel_downsample


def disparity_to_depth(disparity: Column, focal: float, baseline: float) -> Column:
    """0 where there is no disparity."""
    return F.when(disparity > 0, baseline * focal / F.nullif(disparity, F.lit(0.0))).otherwise(0.0)


def backprojected(u: Column, v: Column, d: Column, focal: float, cx: float, cy: float) -> Column:
    """The camera-space point of a pixel at a depth."""
    return vec((u - cx) * d / focal, (v - cy) * d / focal, d)


def depth_points(pixels: DataFrame, focal: float, cx: float, cy: float, farthest: float = 100.0) -> DataFrame:
    """Adds w, the world point, of each pixel (u, v, d, and R, t of its camera) with a depth in (0, farthest)."""
    valid = pixels.where((F.col("d") > 0) & (F.col("d") < farthest)).withColumn("_q", backprojected(F.col("u"), F.col("v"), F.col("d"), focal, cx, cy))
    return valid.withColumn("w", camera_to_world(F.col("_q"), F.col("R"), F.col("t"))).drop("_q")


def dense_cloud(pixels: DataFrame, focal: float, cx: float, cy: float, farthest: float = 50.0, voxel: float = 0.02, colours: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """The points of all frames in one cloud, a mean point and colour (0 to 1) for each voxel."""
    p = depth_points(pixels, focal, cx, cy, farthest).select(*(F.col("w")[k].alias(a) for k, a in enumerate("xyz")), *((F.col(c) / 255.0).alias(c) for c in colours))
    out = voxel_downsample(p, voxel, values=colours)
    return out.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in colours})


def correlation(rows: DataFrame, *by: str) -> DataFrame:
    """Normalised correlation of values a and b of each patch, with population deviations, from sums that combine before the shuffle."""
    n = rows.groupBy(*by).agg(F.covar_pop("a", "b").alias("_c"), F.stddev_pop("a").alias("_a"), F.stddev_pop("b").alias("_b"))
    return n.withColumn("ncc", F.col("_c") / ((F.col("_a") + 1e-8) * (F.col("_b") + 1e-8))).drop("_a", "_b", "_c")


def view_cost(scores: Column) -> Column:
    """Mean of an array of scores without the worst of three or more; -1 of none."""
    s = F.array_sort(F.filter(scores, lambda x: x.isNotNull()))
    kept = F.when(F.size(s) > 2, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
    return F.when(F.size(s) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(kept), F.lit(1))).otherwise(-1.0)


def consistent(pixels: DataFrame, sources: DataFrame, k: Column, focal: float, cx: float, cy: float, reach: float = 2.0) -> DataFrame:
    """u, v, d of a depth map, 0 where a source view does not lead back to the pixel.

    sources: src, R, t, a few views of the one reference camera (R0, t0 in pixels). Each pixel's point is
    projected into a source, the map's depth at the pixel it meets is projected back, and has to land
    within reach, for every source. The pixel met is found by a join.
    """
    p = pixels.select("u", "v", "d", "R0", "t0").where("d > 0").withColumn("_w", camera_to_world(backprojected(F.col("u"), F.col("v"), F.col("d"), focal, cx, cy), F.col("R0"), F.col("t0")))
    at = p.crossJoin(F.broadcast(sources)).withColumn("_q", world_to_camera(F.col("_w"), F.col("R"), F.col("t"))).where(F.col("_q")[2] > 0)
    su, sv = project(F.col("_q"), k)
    at = at.select("u", "v", "src", "R", "t", "R0", "t0", F.rint(su).cast("long").alias("su"), F.rint(sv).cast("long").alias("sv"))
    there = pixels.where("d > 0").select(F.col("u").alias("su"), F.col("v").alias("sv"), F.col("d").alias("sd"))
    back = at.join(there, ["su", "sv"]).withColumn("_w", camera_to_world(backprojected(F.col("su"), F.col("sv"), F.col("sd"), focal, cx, cy), F.col("R"), F.col("t")))
    back = back.withColumn("_q", world_to_camera(F.col("_w"), F.col("R0"), F.col("t0"))).where(F.col("_q")[2] > 0)
    ru, rv = project(F.col("_q"), k)
    good = back.where(F.sqrt((ru - F.col("u")) ** 2 + (rv - F.col("v")) ** 2) < reach).groupBy("u", "v").agg(F.countDistinct("src").alias("_n"))
    views = sources.agg(F.countDistinct("src").alias("_views"))
    out = pixels.join(good, ["u", "v"], "left").crossJoin(F.broadcast(views))
    return out.select("u", "v", F.when(F.col("_n") == F.col("_views"), F.col("d")).otherwise(0.0).alias("d"))


def structural_similarity(pixels: DataFrame, by: str = "img_id", size: int = 7, span: float = 1.0) -> DataFrame:
    """Mean structural similarity of values a and b of each image's pixels (x, y), in uniform windows that lie within it, with sample covariances.

    Window sums go by rows and then by columns, so no pixel meets the others of its window one by one.
    """
    h, n = size // 2, size * size
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    d = pixels.select(by, "x", "y", a.alias("_a"), b.alias("_b"), (a * a).alias("_aa"), (b * b).alias("_bb"), (a * b).alias("_ab"), F.lit(1.0).alias("_n"))
    names = ("_a", "_b", "_aa", "_bb", "_ab", "_n")
    for line, order in (("y", "x"), ("x", "y")):
        w = Window.partitionBy(by, line).orderBy(order).rangeBetween(-h, h)
        d = d.select(by, "x", "y", *(F.sum(c).over(w).alias(c) for c in names))
    d = d.where(F.col("_n") == n)
    ma, mb, unbiased = F.col("_a") / n, F.col("_b") / n, n / (n - 1)
    va, vb, vab = unbiased * (F.col("_aa") / n - ma * ma), unbiased * (F.col("_bb") / n - mb * mb), unbiased * (F.col("_ab") / n - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    s = ((2 * ma * mb + c1) * (2 * vab + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return d.groupBy(by).agg(F.avg(s).alias("ssim"))
