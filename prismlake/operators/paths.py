"""Camera paths: poses that look at a point, as columns over rows of frames.

A pose is a camera-to-world matrix of 16 numbers (row-major). The columns of its rotation are right,
up and backward (y up, looking along -z), or right, down and forward.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import add, cross, mat_vec, norm, scale, sub, vec
from ..session import materialize
from .cameras import center, quaternion, quaternion_matrix, slerp
from .clouds import quantiles

TINY = 1e-8


def looking(frames: DataFrame, position: Column, target: Column, up: Column, spare: Column | None = None, forward_last: bool = False) -> DataFrame:
    """Adds c2w: at a position, looking at the target; where the view runs along up, spare takes its place."""
    d = frames.withColumn("_p", position).withColumn("_f", sub(target, F.col("_p")))
    d = d.withColumn("_f", scale(F.col("_f"), 1 / (norm(F.col("_f")) + TINY))).withColumn("_r", cross(F.col("_f"), up))
    if spare is not None:
        d = d.withColumn("_r", F.when(norm(F.col("_r")) < 1e-6, cross(F.col("_f"), spare)).otherwise(F.col("_r")))
    d = d.withColumn("_r", scale(F.col("_r"), 1 / (norm(F.col("_r")) + TINY))).withColumn("_u", cross(F.col("_r"), F.col("_f")))
    y, z = (scale(F.col("_u"), -1.0), F.col("_f")) if forward_last else (F.col("_u"), scale(F.col("_f"), -1.0))
    d = d.withColumn("_y", y).withColumn("_z", z)
    rows = [F.col(c)[k] for k in range(3) for c in ("_r", "_y", "_z", "_p")]
    return d.withColumn("c2w", vec(*rows, 0, 0, 0, 1)).drop("_p", "_f", "_r", "_u", "_y", "_z")


def orbit(frames: DataFrame, turn: Column, radius: float, height: float) -> DataFrame:
    """A level circle around the origin; turn: angle in radians."""
    return looking(frames, vec(radius * F.cos(turn), height, radius * F.sin(turn)), vec(0, 0, 0), vec(0, 1, 0), vec(0, 0, 1))


def wave(frames: DataFrame, turn: Column, radius: float, height: float) -> DataFrame:
    """A circle around the z axis that rises and falls twice."""
    return looking(frames, vec(radius * F.cos(turn), radius * F.sin(turn), height * F.sin(2 * turn)), vec(0, 0, 0), vec(0, 0, 1))


def levels(frames: DataFrame, index: Column, n: Column, radius: float, elevation: float, levels_: int) -> DataFrame:
    """Views on circles at several elevations (degrees), z forward; those left over by the division repeat the first."""
    each = F.floor(n / levels_)
    i = F.when(index < each * levels_, index).otherwise(0)
    level = F.floor(F.when(each > 0, i / F.greatest(each, F.lit(1))).otherwise(0))
    step = (elevation + elevation / 2) / max(1, levels_ - 1)
    d = frames.withColumn("azimuth_deg", F.degrees(2 * np.pi * (i % F.greatest(each, F.lit(1))) / F.greatest(each, F.lit(1)))).withColumn("elevation_deg", -elevation / 2 + level * step)
    a, e = F.radians("azimuth_deg"), F.radians("elevation_deg")
    return looking(d, vec(radius * F.cos(e) * F.cos(a), radius * F.sin(e), radius * F.cos(e) * F.sin(a)), vec(0, 0, 0), vec(0, 1, 0), vec(0, 0, 1), forward_last=True)


def spiral(frames: DataFrame, t: Column, poses: DataFrame, turns: float = 2.0, rise: float = 0.5, phase: float = 0.0, share: float = 0.75) -> DataFrame:
    """A spiral about the mean of poses (c2w); t: 0 to 1. Mean, radius and mean rotation are one row."""
    poses = materialize(poses.select("c2w"), "poses")  # so that expressions over them start from a column
    c = vec(*(F.col("c2w")[4 * k + 3] for k in range(3)))
    sums = poses.agg(*(F.avg(F.col("c2w")[k]).alias(f"m{k}") for k in range(12)))
    mean = sums.first()
    middle = [mean[f"m{k}"] for k in (3, 7, 11)]
    radius = quantiles(poses.select(norm(sub(c, vec(*middle))).alias("d")), ("d",), 0.75).first()["d"] * share
    u, _, vt = np.linalg.svd(np.array([[mean[f"m{4 * i + j}"] for j in range(3)] for i in range(3)]))
    r = u @ vt
    turn = t * 2 * np.pi * turns
    d = frames.withColumn("_o", vec(radius * F.cos(turn), radius * F.sin(turn), radius * 0.5 * rise * F.sin(t * 2 * np.pi + phase)))
    d = materialize(d.withColumn("_at", add(vec(*middle), mat_vec(vec(*r.ravel().tolist()), F.col("_o")))).drop("_o"), "spiral")
    return looking(d, F.col("_at"), vec(*middle), vec(*r[:, 1].tolist())).drop("_at")


def key_frame_path(keys: DataFrame, frames: int, order: str) -> DataFrame:
    """frame, R, t of so many frames on a path through key cameras (R, t), which follow each other by order at even times.

    Rotations go the short way between neighbours, centres on straight lines. One key stands still; without any there is no frame.
    """
    keys = materialize(keys.select(order, "R", "t"), "keys")  # so that expressions over them start from columns
    place = Window.partitionBy(F.lit(0)).orderBy(order)  # a row for each key
    at = keys.select((F.row_number().over(place) - 1).alias("i"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"), quaternion(F.col("R")).alias("q"), center(F.col("R"), F.col("t")).alias("c"))
    at = materialize(at, "keys")
    n = at.select("n").limit(1)
    f = keys.sparkSession.range(frames).select(F.col("id").alias("frame")).crossJoin(F.broadcast(n))
    f = f.withColumn("time", F.col("frame") * (F.col("n") - 1) / F.lit(float(max(1, frames - 1))))
    f = f.withColumn("i", F.greatest(F.lit(0), F.least(F.floor("time"), F.col("n") - 2)).cast("int")).withColumn("share", F.col("time") - F.col("i"))
    f = f.withColumn("j", F.least(F.col("i") + 1, F.col("n") - 1).cast("int"))
    f = f.join(at.select("i", F.col("q").alias("qa"), F.col("c").alias("ca")), "i").join(at.select(F.col("i").alias("j"), F.col("q").alias("qb"), F.col("c").alias("cb")), "j")
    f = f.withColumn("q", F.when(F.col("i") == F.col("j"), F.col("qa")).otherwise(slerp(F.col("qa"), F.col("qb"), F.col("share"))))
    f = materialize(f.select("frame", "q", add(F.col("ca"), scale(sub(F.col("cb"), F.col("ca")), F.col("share"))).alias("c")), "frames").withColumn("R", quaternion_matrix(F.col("q")))
    return f.select("frame", "R", scale(mat_vec(F.col("R"), F.col("c")), -1.0).alias("t"))
