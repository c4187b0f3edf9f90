"""Whole scenes: the pose graph's nodes, scale and bounds, rays of images, residuals, boxes and frustums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linear import add, det, dot, norm, scale, sub, vec
from .cameras import camera_to_world, center, project, world_to_camera
from .clouds import quantiles
from .poses import next_images
from .ranks import running

#: Centres to a block of those whose distances are summed.
BLOCK = 4000


def _pair_sums(a: pa.Table, b: pa.Table) -> pa.Table:
    """Of two blocks of centres (of one block with itself: each pair once)."""
    total, n = 0.0, 0
    if len(a) and len(b):
        x, y = (np.array(t.column("c").combine_chunks().flatten(), float).reshape(-1, 3) for t in (a, b))
        same = a.column("i")[0].as_py() == b.column("j")[0].as_py()
        for k in range(0, len(x), 500):
            d = np.sqrt(((x[k : k + 500, None, :] - y[None, :, :]) ** 2).sum(axis=2))
            total, n = total + float(d.sum()), n + d.size
        if same:
            total, n = total / 2, (n - len(x)) // 2
    return pa.table({"total": [total], "n": pa.array([n], pa.int64())})


def scene_scale(cameras: DataFrame) -> DataFrame:
    """scale: the mean distance of two camera centres, 1 for fewer than two. Pairs are summed in block pairs, and none is a row."""
    c = cameras.select("img_id", center(F.col("R"), F.col("t")).alias("c"))
    parts = c.agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    c = c.crossJoin(F.broadcast(parts)).withColumn("part", F.pmod(F.xxhash64("img_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = c.where("part <= other").select(F.col("part").alias("i"), F.col("other").alias("j"), "c").toDF("i", "j", "c")
    right = c.where("part >= other").select(F.col("other").alias("i"), F.col("part").alias("j"), "c").toDF("i", "j", "c")
    sums = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_pair_sums, "total double, n long")
    return sums.agg(F.coalesce(F.try_divide(F.sum("total"), F.sum("n")), F.lit(1.0)).alias("scale"))


def decompose_projection(d: DataFrame, p: str = "P") -> DataFrame:
    """Adds K (9 numbers, the last 1), R and t of projection matrices of 12 numbers, by orthogonalising rows from the last up. The sign of a matrix is as free as its scale: that counts under which R is a rotation."""
    given, p = p, "_P"
    flip = F.when(det(vec(*(F.col(given)[4 * i + j] for i in range(3) for j in range(3)))) < 0, -1.0).otherwise(1.0)
    d = d.withColumn("_s", flip).withColumn(p, vec(*(F.col(given)[i] * F.col("_s") for i in range(12))))
    row = lambda k: vec(*(F.col(p)[4 * k + j] for j in range(3)))
    d = d.withColumn("_k22", norm(row(2))).withColumn("_r2", scale(row(2), 1 / F.col("_k22")))
    d = d.withColumn("_k12", dot(row(1), F.col("_r2"))).withColumn("_b", sub(row(1), scale(F.col("_r2"), F.col("_k12"))))
    d = d.withColumn("_k11", norm(F.col("_b"))).withColumn("_r1", scale(F.col("_b"), 1 / F.col("_k11")))
    d = d.withColumn("_k02", dot(row(0), F.col("_r2"))).withColumn("_k01", dot(row(0), F.col("_r1")))
    d = d.withColumn("_c", sub(sub(row(0), scale(F.col("_r2"), F.col("_k02"))), scale(F.col("_r1"), F.col("_k01"))))
    d = d.withColumn("_k00", norm(F.col("_c"))).withColumn("_r0", scale(F.col("_c"), 1 / F.col("_k00")))
    d = d.withColumn("_t2", F.col(p)[11] / F.col("_k22")).withColumn("_t1", (F.col(p)[7] - F.col("_k12") * F.col("_t2")) / F.col("_k11"))
    d = d.withColumn("_t0", (F.col(p)[3] - F.col("_k01") * F.col("_t1") - F.col("_k02") * F.col("_t2")) / F.col("_k00"))
    k = vec(*(F.col(c) / F.col("_k22") for c in ("_k00", "_k01", "_k02")), 0, *(F.col(c) / F.col("_k22") for c in ("_k11", "_k12")), 0, 0, 1)
    r = vec(*(F.col(f"_r{i}")[j] for i in range(3) for j in range(3)))
    return d.withColumns({"K": k, "R": r, "t": vec(F.col("_t0"), F.col("_t1"), F.col("_t2"))}).drop("_k22", "_r2", "_k12", "_b", "_k11", "_r1", "_k02", "_k01", "_c", "_k00", "_r0", "_t0", "_t1", "_t2", "_P", "_s")


def has_node(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds present to rows of img_id."""
    return asked.join(nodes.select("img_id").distinct().withColumn("_there", F.lit(True)), "img_id", "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")


def get_poses(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """R and t of rows of img_id, null where the graph lacks the node."""
    return asked.join(nodes.select("img_id", "R", "t"), "img_id", "left")


def update_poses(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Nodes with the poses of updates (img_id, R, t) where they have one; updates of absent nodes do nothing."""
    u = updates.select("img_id", F.col("R").alias("_R"), F.col("t").alias("_t"))
    return nodes.join(u, "img_id", "left").withColumns({"R": F.coalesce("_R", "R"), "t": F.coalesce("_t", "t")}).drop("_R", "_t")


def best_next(edges: DataFrame, registered: DataFrame) -> DataFrame:
    """The image with the most edges to registered ones, the first of equals; no row where none has any."""
    return next_images(edges, registered).orderBy(F.desc("links"), "img_id").limit(1)


def trajectory(nodes: DataFrame) -> DataFrame:
    """img_id and camera centre c, by index."""
    return nodes.select("img_id", center(F.col("R"), F.col("t")).alias("c")).orderBy("img_id")


def baselines(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds to rows of i, j the distance of their centres, 0 where one is missing."""
    c = nodes.select("img_id", center(F.col("R"), F.col("t")).alias("c"))
    d = pairs.join(c.toDF("i", "_a"), "i", "left").join(c.toDF("j", "_b"), "j", "left")
    return d.withColumn("baseline", F.coalesce(norm(sub(F.col("_a"), F.col("_b"))), F.lit(0.0))).drop("_a", "_b")


NODE, EDGE = "struct<img_id:long,R:array<double>,t:array<double>>", "struct<src:long,dst:long,weight:long>"


def to_json(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """A JSON line for each node, and for each edge (src, dst, weight), which from_json() and edges_from_json() read back; files of lines are read and written in parts."""
    lines = nodes.select(F.to_json(F.struct(F.col("img_id").cast("long").alias("img_id"), "R", "t")).alias("value"))
    return lines if edges is None else lines.unionByName(edges.select(F.to_json(F.struct(*(F.col(c).cast("long").alias(c) for c in ("src", "dst", "weight")))).alias("value")))


def from_json(lines: DataFrame) -> DataFrame:
    """The nodes of a graph's lines."""
    return lines.select(F.from_json("value", NODE).alias("x")).select("x.*").where("img_id IS NOT NULL")


def edges_from_json(lines: DataFrame) -> DataFrame:
    """The edges of a graph's lines."""
    return lines.select(F.from_json("value", EDGE).alias("x")).select("x.*").where("src IS NOT NULL")


def image_rays(cameras: DataFrame, width: int, height: int, focal: float, cx: float, cy: float, focal_y: float | None = None) -> DataFrame:
    """img_id, row, col, origin and unit direction in the world of every pixel's ray."""
    d = cameras.withColumn("origin", center(F.col("R"), F.col("t"))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    q = vec((F.col("col") - cx) / focal, (F.col("row") - cy) / (focal_y or focal), 1)
    d = d.withColumn("_d", camera_to_world(add(q, F.col("t")), F.col("R"), F.col("t")))
    return d.select("img_id", "row", "col", "origin", scale(F.col("_d"), 1 / (norm(F.col("_d")) + 1e-8)).alias("direction"))


def normalized(cameras: DataFrame, share: float = 0.9) -> DataFrame:
    """img_id, c (centre about the mean centre, by the scale), mean and scale: the share's quantile of distances, 1 where that vanishes."""
    c = cameras.select("img_id", center(F.col("R"), F.col("t")).alias("_c"))
    mean = c.agg(vec(*(F.avg(F.col("_c")[k]) for k in range(3))).alias("mean"))
    d = c.crossJoin(F.broadcast(mean)).withColumn("_d", sub(F.col("_c"), F.col("mean")))
    far = quantiles(d.select(norm(F.col("_d")).alias("scale")), ("scale",), share).select(F.when(F.col("scale") < 1e-8, 1.0).otherwise(F.col("scale")).alias("scale"))
    return d.crossJoin(F.broadcast(far)).select("img_id", scale(F.col("_d"), 1 / F.col("scale")).alias("c"), "mean", "scale")


def denormalized(scene: DataFrame) -> DataFrame:
    """img_id and centre in the former scale, of rows of normalized()."""
    return scene.select("img_id", add(scale(F.col("c"), F.col("scale")), F.col("mean")).alias("c"))


def near_far(depths: DataFrame, near: float = 0.001, far: float = 0.999) -> DataFrame:
    """near (0.01 at least) and far: quantiles of the positive depths z."""
    z = depths.where("z > 0").select("z")
    return quantiles(z, ("z",), near).toDF("near").crossJoin(quantiles(z, ("z",), far).toDF("far")).select(F.greatest(F.lit(0.01), F.col("near")).alias("near"), "far")


def spacing_near_far(cameras: DataFrame) -> DataFrame:
    """near and far by the cameras' spacing, where there are no points."""
    c = cameras.select(center(F.col("R"), F.col("t")).alias("c"))
    mean = c.agg(vec(*(F.avg(F.col("c")[k]) for k in range(3))).alias("mean"))
    d = c.crossJoin(F.broadcast(mean)).select(norm(sub(F.col("c"), F.col("mean"))).alias("d"))
    return d.agg(F.greatest(F.lit(0.01), F.min("d") * 0.1).alias("near"), (F.max("d") * 5).alias("far"))


def box_normal(local: Column) -> Column:
    """Outward normal at a point of a box about the origin: the sign on the axis that is largest, the first of equals."""
    a, b, c = (F.abs(local[k]) for k in range(3))
    x, y = (a >= b) & (a >= c), b >= c
    return vec(F.when(x, F.sign(local[0])).otherwise(0), F.when(~x & y, F.sign(local[1])).otherwise(0), F.when(~x & ~y, F.sign(local[2])).otherwise(0))


def residuals(seen: DataFrame, k: Column, fixed: Column | None = None) -> DataFrame:
    """Adds du, dv of observations (R, t, p, u, v), and whether the camera is held still; points behind it have residuals of 0."""
    d = seen.withColumn("_q", world_to_camera(F.col("p"), F.col("R"), F.col("t")))
    u, v = project(F.col("_q"), k)
    ahead = F.col("_q")[2] > 1e-8
    return d.withColumns({"du": F.when(ahead, u - F.col("u")).otherwise(0.0), "dv": F.when(ahead, v - F.col("v")).otherwise(0.0), "fixed": fixed if fixed is not None else F.lit(False)}).drop("_q")


EDGES = ((0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 3), (3, 4), (4, 1))


def frustum_segments(cameras: DataFrame, width: int, height: int, focal: float, size: float = 0.3) -> DataFrame:
    """img_id, edge, a, b: the eight segments of each camera's frustum in the world."""
    w, h = width / 2 * size / focal, height / 2 * size / focal
    corners = ((0, 0, 0), (-w, -h, size), (w, -h, size), (w, h, size), (-w, h, size))
    edges = F.array(*(F.struct(F.lit(i).alias("edge"), vec(*corners[a]).alias("a"), vec(*corners[b]).alias("b")) for i, (a, b) in enumerate(EDGES)))
    d = cameras.select("img_id", "R", "t", F.explode(edges).alias("x"))
    return d.select("img_id", "x.edge", *(camera_to_world(F.col(f"x.{c}"), F.col("R"), F.col("t")).alias(c) for c in "ab"))


def training_curve(loss: DataFrame, by: str, order: list[str], value: str, window: int | None = None) -> DataFrame:
    """smooth: the mean of each row and those before it, of full windows only. Without window it is a tenth of a run's rows, 500 at most, of runs of more than 100."""
    d = running(loss, [by], order, value)
    d = d.withColumn("_w", F.lit(window) if window else F.least(F.lit(500), F.floor(F.col("_n") / 10)))
    d = d if window else d.where("_n > 100")
    before = d.select(F.col(by).alias("_by"), (F.col("_at") + F.col("_w")).alias("_to"), F.col("_s").alias("_before"))
    d = d.where("_at >= _w").join(before, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_at") == F.col("_to")), "left")
    return d.withColumn("smooth", (F.col("_s") - F.coalesce("_before", F.lit(0.0))) / F.col("_w")).drop("_n", "_at", "_w", "_s", "_by", "_to", "_before")


def _normals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        m = np.array(batch.column("m").flatten(), float).reshape(-1, 3, 3)
        v = np.linalg.eigh(m)[1][:, :, 0] if len(m) else np.empty((0, 3))
        rows = pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), 3).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("pt_id"), rows], names=["pt_id", "n"])


def normals(points: DataFrame, near: DataFrame, view: tuple[float, float, float] | None = None) -> DataFrame:
    """pt_id, n: the direction in which a point and its neighbours (pt_id, nn_id) spread least, turned to the view or to the cloud's mean.

    Sums of coordinates and of their products combine before the shuffle; only 3x3 matrices meet Python, in batches.
    """
    xyz = ("x", "y", "z")
    own = near.select("pt_id", "nn_id").unionByName(points.select("pt_id", F.col("pt_id").alias("nn_id")))
    d = own.join(points.select(F.col("pt_id").alias("nn_id"), *xyz), "nn_id")
    pairs = [(a, b) for a in xyz for b in xyz]
    m = d.groupBy("pt_id").agg(F.array(*(F.covar_pop(a, b) for a, b in pairs)).alias("m")).select("pt_id", "m")
    n = m.mapInArrow(_normals, "pt_id long, n array<double>")
    to = points.agg(vec(*(F.avg(a) for a in xyz)).alias("_to")) if view is None else points.sparkSession.range(1).select(vec(*view).alias("_to"))
    out = n.join(points.select("pt_id", vec(*(F.col(a) for a in xyz)).alias("_p")), "pt_id").crossJoin(F.broadcast(to))
    side = F.when(dot(F.col("n"), sub(F.col("_to"), F.col("_p"))) < 0, -1.0).otherwise(1.0)
    return out.select("pt_id", scale(F.col("n"), side).alias("n"))
