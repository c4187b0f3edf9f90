"""Point clouds: voxels, statistics, outliers, exact neighbours by grid cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, materialize
from .ranks import group_quantile

#: Points to a cell of an evenly filled box, points around a cell to one task, and pairs compared at once.
CELL_POINTS, PART_POINTS, BLOCK_PAIRS = 24, 50_000, 2_000_000
#: Points of one cell that begin with narrower cells, and how often cells are cut to a quarter of their width.
CROWD, MOST_LEVELS = 2_000, 12


def voxel_downsample(points: DataFrame, size: float, axes: tuple[str, ...] = ("x", "y", "z"), values: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """One row a voxel: its cell (from the cloud's minimum), centroid, mean values and number of points.

    The origin is one row; the aggregate by cell combines before its shuffle.
    """
    origin = points.agg(*(F.min(a).alias(f"_o{a}") for a in axes))
    cells = points.crossJoin(F.broadcast(origin)).withColumns({f"i{a}": F.floor((F.col(a) - F.col(f"_o{a}")) / size).cast("long") for a in axes})
    return cells.groupBy(*(f"i{a}" for a in axes)).agg(*(F.avg(c).alias(c) for c in (*axes, *values)), F.count("*").alias("n"))


def box_stats(points: DataFrame, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Count, bounding box, centroid and diagonal in one aggregate."""
    d = points.agg(F.count("*").alias("n"), *(f(a).alias(f"{name}_{a}") for a in axes for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))))
    return d.withColumn("diagonal", F.sqrt(sum(((F.col(f"max_{a}") - F.col(f"min_{a}")) ** 2 for a in axes[1:]), (F.col(f"max_{axes[0]}") - F.col(f"min_{axes[0]}")) ** 2)))


def quantiles(rows: DataFrame, columns: tuple[str, ...], share: float) -> DataFrame:
    """One row: of each column the value at a share of its order, interpolated between neighbours; nulls don't count."""
    out = None
    for c in columns:
        one = group_quantile(rows, [], c, share)
        out = one if out is None else out.crossJoin(one)
    return out


def remove_outliers(points: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), spread: float = 3.0) -> DataFrame:
    """Points within spread deviations (population) of the median on every axis."""
    middle = quantiles(points, axes, 0.5).toDF(*(f"_m{a}" for a in axes))
    stats = points.agg(*(F.stddev_pop(a).alias(f"_s{a}") for a in axes)).crossJoin(middle)
    inside = None
    for a in axes:
        ok = F.abs(F.col(a) - F.col(f"_m{a}")) < spread * (F.col(f"_s{a}") + 1e-9)
        inside = ok if inside is None else inside & ok
    return points.crossJoin(F.broadcast(stats)).where(inside).select(points.columns)


def _nearest(k: int, axes: tuple[str, ...]):
    """Of a cell's points and of those in it and around it: each point's k nearest others, in blocks of bounded size."""
    schema = pa.schema([("pt_id", pa.int64()), ("nn_id", pa.int64()), ("d", pa.float64())])

    def run(queries: pa.Table, base: pa.Table) -> pa.Table:
        if not len(queries) or not len(base):
            return schema.empty_table()
        base = base.sort_by("nn_id")  # so that equal distances stay in the order of ids
        ids, q_ids, parts = np.array(base.column("nn_id")), np.array(queries.column("pt_id")), []
        step = max(1, BLOCK_PAIRS // len(ids))
        for a in range(0, len(q_ids), step):
            square = None
            for axis in axes:
                x = np.array(queries.column(axis))[a : a + step, None] - np.array(base.column(axis))[None, :]
                square = x * x if square is None else square + x * x
            d = np.sqrt(square)
            d[q_ids[a : a + step, None] == ids[None, :]] = np.inf
            n = min(k, len(ids))
            if n < len(ids):
                bound = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
                row, col = np.nonzero(d <= bound)
            else:
                row, col = np.nonzero(np.isfinite(d))
            order = np.lexsort((ids[col], d[row, col], row))
            row, col = row[order], col[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = (rank < k) & np.isfinite(d[row, col])
            row, col = row[keep], col[keep]
            parts.append(pa.Table.from_arrays([pa.array(q_ids[a + row]), pa.array(ids[col]), pa.array(d[row, col])], schema=schema))
        return pa.concat_tables(parts)

    return run


def _cells(width: float, axes: tuple[str, ...]) -> dict:
    return {f"c{a}": F.floor(F.col(a) / width).cast("long") for a in axes}


def _crowds(points: DataFrame, width: float, axes: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """Adds level: how often a point's cell must be cut to a quarter of its width until it isn't crowded."""
    out, rest, names = None, points.withColumn("level", F.lit(0)), [f"c{a}" for a in axes]
    for level in range(MOST_LEVELS):
        placed = rest.withColumns(_cells(width / 4**level, axes))
        crowded = scratch.table(placed.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(*names), "crowded")
        calm = placed.join(crowded, names, "left_anti").select(*points.columns, "level") if not crowded.isEmpty() else rest
        out = calm if out is None else out.unionByName(calm)
        if crowded.isEmpty():
            return out
        rest = scratch.table(placed.join(crowded, names, "left_semi").select(*points.columns, F.lit(level + 1).alias("level")), "crowd")
    return out.unionByName(rest)  # what is left lies in one place


def neighbours(points: DataFrame, k: int, cell: float | None = None, axes: tuple[str, ...] = ("x", "y", "z"), queries: DataFrame | None = None) -> DataFrame:
    """pt_id, nn_id, d, rank: the exact k nearest others of every point, ties by id; of every row of queries, whose ids are no points' ids, if given.

    Points meet in a grid: each cell's points are compared with those in the 27 cells around it, in
    blocks. A point is settled once its k-th distance is at most a cell's width, since all nearer points
    were seen; the others go on with cells four times as wide, until all are settled. Points of crowded
    cells begin with narrower ones. Without cell the first width comes from the density of the box that
    holds all but the outermost hundredth of each axis, so that far points don't widen it. Cells with many
    points around are dealt in parts, and so are many points of one cell.
    """
    scratch = Scratch(points.sparkSession)
    tidy = lambda d: d.select(F.col("pt_id").cast("long").alias("pt_id"), *(F.col(a).cast("double").alias(a) for a in axes))
    every = scratch.table(tidy(points), "points")
    # of one place the k smallest ids, and one more, as a point isn't its own neighbour
    first = Window.partitionBy(*axes).orderBy("pt_id")
    rows = scratch.table(every.withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= k + (queries is None)).drop("_n"), "places")
    asked, alike = every, None
    if queries is not None:
        alike = scratch.table(tidy(queries).withColumn("_first", F.min("pt_id").over(Window.partitionBy(*axes))), "queries")
        asked = alike.where("pt_id = _first").select("pt_id", *axes).distinct()
    ends = rows.agg(F.count("*").alias("n"), *(F.percentile_approx(a, F.array(F.lit(0.01), F.lit(0.99)), 1000).alias(a) for a in axes)).first()
    want, width = min(k, ends.n - (queries is None)), cell
    if not width:
        sides = [ends[a][1] - ends[a][0] for a in axes if ends.n and ends[a][1] > ends[a][0]]
        width = (math.prod(sides) * max(CELL_POINTS, 2 * k) / ends.n) ** (1 / len(sides)) if sides else 1.0
    names, offsets = [f"c{a}" for a in axes], F.explode(F.array(*(F.array(*(F.lit(n // 3**i % 3 - 1) for i in range(len(axes)))) for n in range(3 ** len(axes)))))
    asked = scratch.table(_crowds(asked, width, axes, scratch), "levels") if want > 0 else asked.withColumn("level", F.lit(0))
    level = (asked.agg(F.max("level")).first()[0] or 0) if want > 0 else 0
    left, out = asked.where(F.col("level") == level).drop("level"), None
    while want > 0:
        wide = width / 4.0**level
        probe = left.withColumns(_cells(wide, axes))
        # the cells around each asked cell, each with the asked cell that it is near
        around = probe.select(*(F.col(c).alias(f"to_{c}") for c in names)).distinct().withColumn("o", offsets)
        around = around.select(*(f"to_{c}" for c in names), *((F.col(f"to_{c}") + F.col("o")[i]).alias(c) for i, c in enumerate(names)))
        base = rows.withColumnRenamed("pt_id", "nn_id").withColumns(_cells(wide, axes)).join(around, names).select("nn_id", *axes, *(F.col(f"to_{c}").alias(c) for c in names))
        sizes = base.groupBy(*names).agg(F.ceil(F.count("*") / PART_POINTS).cast("int").alias("parts"))
        shares = probe.groupBy(*names).agg(F.ceil(F.count("*") / PART_POINTS).cast("int").alias("shares"))
        sizes = sizes.join(shares, names)
        base = base.join(sizes, names).withColumn("part", F.pmod(F.xxhash64("nn_id"), F.col("parts")).cast("int")).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        seek = probe.join(sizes, names).withColumn("share", F.pmod(F.xxhash64("pt_id"), F.col("shares")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = [*names, "part", "share"]
        base, seek = (d.select(*keep).toDF(*keep) for d, keep in ((base, [*keys, "nn_id", *axes]), (seek, [*keys, "pt_id", *axes])))
        near = seek.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInArrow(_nearest(want, axes), "pt_id long, nn_id long, d double")
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy("pt_id").orderBy("d", "nn_id"))).where(F.col("rank") <= want)
        near = materialize(near, "near")
        sure = near.groupBy("pt_id").agg(F.max("d").alias("far"), F.count("*").alias("found")).where((F.col("found") == want) & (F.col("far") <= wide)).select("pt_id")
        part = near.join(sure, "pt_id", "left_semi")
        out = part if out is None else out.unionByName(part)
        left = left.join(sure, "pt_id", "left_anti")
        level -= 1
        if level >= 0:
            left = left.unionByName(asked.where(F.col("level") == level).drop("level"))
        left = scratch.table(left, "left")
        if level < 0 and left.isEmpty():
            break
    if out is not None and alike is not None:
        out = out.withColumnRenamed("pt_id", "_first").join(alike.select("pt_id", "_first").distinct(), "_first").select("pt_id", "nn_id", "d", "rank")
    out = materialize(out, "neighbours") if out is not None else rows.sparkSession.createDataFrame([], "pt_id long, nn_id long, d double, rank int")
    scratch.clear()
    return out


def statistical_outliers(points: DataFrame, k: int = 20, spread: float = 2.0, cell: float | None = None) -> DataFrame:
    """pt_id, mean_distance, keep: points whose mean distance to k neighbours is below mean + spread deviations."""
    mean = materialize(neighbours(points, k, cell).groupBy("pt_id").agg(F.avg("d").alias("mean_distance")), "mean")
    stats = mean.agg(F.avg("mean_distance").alias("_m"), F.stddev_pop("mean_distance").alias("_s"))
    return mean.crossJoin(F.broadcast(stats)).select("pt_id", "mean_distance", (F.col("mean_distance") < F.col("_m") + spread * F.col("_s")).alias("keep"))


def scene_scale(points: DataFrame, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Centroid and the 90th percentile of distances from it, 1 where that vanishes."""
    mean = points.agg(*(F.avg(a).alias(f"c{a}") for a in axes))
    d = F.sqrt(sum(((F.col(a) - F.col(f"c{a}")) ** 2 for a in axes[1:]), (F.col(axes[0]) - F.col(f"c{axes[0]}")) ** 2))
    far = quantiles(points.crossJoin(F.broadcast(mean)).select(d.alias("p90")), ("p90",), 0.9)
    scaled = mean.crossJoin(far)
    return scaled.withColumn("scale", F.when(F.col("p90") < 1e-8, 1.0).otherwise(F.col("p90")))
