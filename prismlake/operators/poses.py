"""Reprojection statistics, view selection and the pose graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import norm, sub, vec
from ..session import materialize
from .cameras import camera_to_world, center, project, rotation_angle, world_to_camera
from .ranks import group_quantile, joined

#: Cameras to a block, on average, and pairs that are compared at once.
BLOCK, PAIRS = 4000, 1_000_000


def reprojection_errors(seen: DataFrame, k: Column) -> DataFrame:
    """Adds the pixel error of each observation (R, t, p, u, v); points behind the camera have none."""
    d = seen.withColumn("_q", world_to_camera(F.col("p"), F.col("R"), F.col("t"))).where(F.col("_q")[2] > 0)
    u, v = project(F.col("_q"), k)
    return d.withColumn("error", F.sqrt((u - F.col("u")) ** 2 + (v - F.col("v")) ** 2)).drop("_q")


def mean_error(errors: DataFrame) -> DataFrame:
    """n, mean_error: one row; over nothing the mean is infinite."""
    return errors.agg(F.count("*").alias("n"), F.coalesce(F.avg("error"), F.lit(float("inf"))).alias("mean_error"))


def error_stats(errors: DataFrame, *by: str) -> DataFrame:
    """n, mean, median, largest and population deviation; over nothing the mean is infinite. Medians are exact, and no task holds a group's errors."""
    e = F.col("error")
    stats = errors.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.avg(e), F.lit(float("inf"))).alias("mean_error"), F.max(e).alias("max_error"), F.stddev_pop(e).alias("std_error"))
    middle = group_quantile(errors, [*by], "error", 0.5).withColumnRenamed("error", "median_error")
    return joined(stats, middle, [*by], "left")


def stereo_score(baseline: Column, angle: Column, least: float = 1e-4, widest: float = 45.0) -> Column:
    return F.when((baseline < least) | (angle > widest), 0.0).otherwise(baseline / (1 + angle / 10))


def stereo_pairs(cameras: DataFrame, reach: int = 5) -> DataFrame:
    """i, j, score of views at most reach indices apart. The band is an equi-join on i + step, not a loop over all pairs."""
    a = cameras.select(F.col("img_id").alias("i"), F.col("R").alias("ra"), center(F.col("R"), F.col("t")).alias("ca"))
    b = cameras.select(F.col("img_id").alias("j"), F.col("R").alias("rb"), center(F.col("R"), F.col("t")).alias("cb"))
    d = a.withColumn("j", F.explode(F.array(*(F.col("i") + s for s in range(1, reach + 1))))).join(b, "j")
    d = d.select("i", "j", norm(sub(F.col("ca"), F.col("cb"))).alias("baseline"), rotation_angle(F.col("ra"), F.col("rb")).alias("angle"))
    return d.select("i", "j", stereo_score(F.col("baseline"), F.col("angle")).alias("score"))


def best_stereo_pairs(cameras: DataFrame, most: int, reach: int = 5) -> DataFrame:
    """The pairs of the highest positive scores, at most so many, ties by indices."""
    return stereo_pairs(cameras, reach).where("score > 0").orderBy(F.desc("score"), "i", "j").limit(most)


def _packed(key: tuple, t: pa.Table) -> pa.Table:
    poses = np.column_stack([np.array(t.column(c).combine_chunks().flatten(), float).reshape(len(t), -1) for c in ("R", "c")])
    return pa.table([*(pa.array([x.as_py()], kind) for x, kind in zip(key, (*[pa.int64()] * 3, pa.int32()), strict=True)), [np.array(t.column("img_id"), np.int64).tobytes()], [poses.tobytes()]], names=["g0", "g1", "g2", "part", "ids", "poses"])


def _best_views(most: int, least: float, far: float, widest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs of blocks: each camera's best views among the other block's, ties by index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                i, j = (np.frombuffer(row[c], np.int64) for c in ("ids", "other_ids"))
                a, b = (np.frombuffer(row[c]).reshape(-1, 12) for c in ("poses", "other_poses"))
                order = np.argsort(j, kind="stable")
                j, b = j[order], b[order]
                step = max(1, PAIRS // len(j))
                for k in range(0, len(i), step):
                    x = a[k : k + step]
                    square = sum((x[:, None, n] - b[None, :, n]) ** 2 for n in (9, 10, 11))
                    trace = x[:, None, 0] * b[None, :, 0]
                    for n in range(1, 9):
                        trace += x[:, None, n] * b[None, :, n]
                    baseline, angle = np.sqrt(square), np.degrees(np.arccos(np.clip((trace - 1) / 2, -1, 1)))
                    good = (baseline > least) & (baseline < far) & (angle < widest) & (i[k : k + step, None] != j)
                    score = np.where(good, np.floor(baseline / (1 + angle / 20) * 1e9 + 0.5) / 1e9, -1.0)
                    rows = np.arange(len(x))
                    for _ in range(min(most, len(j))):
                        best = score.argmax(axis=1)  # of equals the first, which has the smaller id
                        value = score[rows, best]
                        score[rows, best] = -1.0
                        keep = value >= 0
                        yield pa.RecordBatch.from_arrays([pa.array(i[k : k + step][keep]), pa.array(j[best][keep]), pa.array(value[keep])], names=["i", "j", "score"])

    return run


def source_views(cameras: DataFrame, most: int = 4, least: float = 0.01, far: float = 10.0, widest: float = 60.0) -> DataFrame:
    """i, j, rank: of all other cameras the best source views of each, ties and views of score zero by index.

    Only centres less than far apart can score, so cameras meet in cells of that size and their neighbours.
    A cell's cameras lie in blocks, and blocks are compared whole: pairs are no rows, only the best of each block pair.
    """
    kind = cameras.schema["img_id"].dataType
    at = cameras.where("img_id IS NOT NULL").select(F.col("img_id").cast("long").alias("img_id"), "R", center(F.col("R"), F.col("t")).alias("c"))
    at = at.where(F.forall(F.concat("R", "c"), lambda x: x.isNotNull() & ~F.isnan(x)))
    cell = ["g0", "g1", "g2"]
    at = at.select("img_id", "R", "c", *(F.floor(F.col("c")[k] / far).cast("long").alias(f"g{k}") for k in range(3)))
    parts = at.groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    at = at.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("img_id"), F.col("parts")).cast("int"))
    blocks = materialize(at.groupBy(*cell, "part").applyInArrow(_packed, "g0 long, g1 long, g2 long, part int, ids binary, poses binary"), "blocks")
    a = blocks
    for c in cell:
        a = a.withColumn(c, F.explode(F.array(*(F.col(c) + s for s in (-1, 0, 1)))))
    b = blocks.withColumnsRenamed({"part": "other", "ids": "other_ids", "poses": "other_poses"})
    tasks = int(cameras.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = a.join(b, cell).repartition(tasks, F.xxhash64("ids"), F.xxhash64("other_ids"))
    d = both.select("ids", "poses", "other_ids", "other_poses").mapInArrow(_best_views(most, least, far, widest), "i long, j long, score double")
    order = Window.partitionBy("i").orderBy(F.desc("score"), "j")
    rank = F.row_number().over(order).alias("rank")
    best = d.select(F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "score").select("*", rank).where(F.col("rank") <= most)
    # a camera that lacks views has fewer than most of its own: with itself that leaves enough of the first 2 * most
    first = cameras.select(F.col("img_id").alias("j")).orderBy("j").limit(2 * most)
    rest = cameras.select(F.col("img_id").alias("i")).crossJoin(F.broadcast(first)).where("i <> j").select("i", "j", F.lit(0.0).alias("score"))
    both = best.select("i", "j", "score").unionByName(rest).groupBy("i", "j").agg(F.max("score").alias("score"))
    return both.select("i", "j", rank).where(F.col("rank") <= most)


def symmetric(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select("src", "dst", *more).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more))


def next_images(edges: DataFrame, registered: DataFrame) -> DataFrame:
    """Images not yet registered and their number of edges to registered ones: the largest comes next."""
    e = symmetric(edges)
    to = e.join(registered.select(F.col("img_id").alias("dst")), "dst", "left_semi")
    fresh = to.join(registered.select(F.col("img_id").alias("src")), "src", "left_anti")
    return fresh.groupBy(F.col("src").alias("img_id")).agg(F.count("*").alias("links"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: an aggregate, which combines before its shuffle."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_x")).select(key, "_x.*")


def frustum_corners(cameras: DataFrame, half_width: float, half_height: float, depth: float) -> DataFrame:
    """img_id, corner, w: the far corners of each camera's frustum in the world."""
    corners = F.array(*(F.struct(F.lit(i).alias("corner"), vec(x, y, depth).alias("q")) for i, (x, y) in enumerate(((-half_width, -half_height), (half_width, -half_height), (half_width, half_height), (-half_width, half_height)))))
    d = cameras.select("img_id", "R", "t", F.explode(corners).alias("x")).select("img_id", "R", "t", "x.corner", "x.q")
    return d.select("img_id", "corner", camera_to_world(F.col("q"), F.col("R"), F.col("t")).alias("w"))
