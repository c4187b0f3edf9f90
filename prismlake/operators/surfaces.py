"""Surfaces of points with normals: consistent orientation, and signed distances on a grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import dot, norm, scale, sub, vec
from ..session import Scratch, materialize
from .clouds import neighbours
from .fusion import AXES, extract_mesh


def orient_normals(normals: DataFrame, near: DataFrame) -> DataFrame:
    """pt_id, n of unit length: normals turned so that they agree along the minimum spanning forest of their neighbours (pt_id, nn_id).

    An edge costs 1 less the size of its normals' product, ties go by ids; the smallest id of each tree
    keeps its normal. In each round every tree takes its cheapest edge to another (Boruvka), so their number
    halves at least; a tree then follows its parents to the root by doubling steps, and signs multiply on
    the way. No step walks along paths. All joins meet by shuffles, since files of ids are small beside what
    they hold: broadcasts of labels would pass the driver in every round.
    """
    scratch = Scratch(normals.sparkSession)
    own = scratch.table(normals.select("pt_id", "n"), "normals")
    pairs = near.where("pt_id <> nn_id").select(F.least("pt_id", "nn_id").alias("lo"), F.greatest("pt_id", "nn_id").alias("hi")).distinct()
    product = dot(F.col("n_lo"), F.col("n_hi"))
    edges = pairs.join(own.select(F.col("pt_id").alias("lo"), F.col("n").alias("n_lo")).hint("merge"), "lo").join(own.select(F.col("pt_id").alias("hi"), F.col("n").alias("n_hi")).hint("merge"), "hi")
    edges = scratch.table(edges.select("lo", "hi", (1 - F.abs(product)).alias("cost"), F.when(product < 0, -1).otherwise(1).alias("sign")), "edges")
    labels = own.select("pt_id", F.col("pt_id").alias("tree"), F.lit(1).alias("turn"))
    while True:
        labels = scratch.table(labels, "labels")
        of = lambda c, labels=labels: labels.select(F.col("pt_id").alias(c), F.col("tree").alias(f"tree_{c}"), F.col("turn").alias(f"turn_{c}")).hint("merge")
        across = edges.join(of("lo"), "lo").join(of("hi"), "hi").where("tree_lo <> tree_hi")
        edges = scratch.table(across.select("lo", "hi", "cost", "sign"), "edges")
        if edges.isEmpty():
            break
        turn = F.col("sign") * F.col("turn_lo") * F.col("turn_hi")
        sides = across.select(F.col("tree_lo").alias("tree"), "cost", "lo", "hi", F.col("tree_hi").alias("to"), turn.alias("turn")).unionByName(across.select(F.col("tree_hi").alias("tree"), "cost", "lo", "hi", F.col("tree_lo").alias("to"), turn.alias("turn")))
        best = sides.groupBy("tree").agg(F.min(F.struct("cost", "lo", "hi", "to", "turn")).alias("x")).select("tree", F.col("x.to").alias("parent"), F.col("x.turn").alias("turn"))
        best = scratch.table(best, "parents")
        # two trees that take the same edge would follow each other: the smaller one is the root
        back = best.select(F.col("tree").alias("parent"), F.col("parent").alias("grand"))
        root = (F.col("grand") == F.col("tree")) & (F.col("tree") < F.col("parent"))
        up = best.join(back.hint("merge"), "parent", "left").select("tree", F.when(root, F.col("tree")).otherwise(F.col("parent")).alias("parent"), F.when(root, 1).otherwise(F.col("turn")).alias("turn"))
        while True:
            up = scratch.table(up, "roots")
            over = up.select(F.col("tree").alias("parent"), F.col("parent").alias("grand"), F.col("turn").alias("more"))
            up = up.join(over.hint("merge"), "parent", "left").select("tree", F.coalesce("grand", "parent").alias("parent"), (F.col("turn") * F.coalesce("more", F.lit(1))).alias("turn"), (F.coalesce("grand", "parent") != F.col("parent")).alias("moved"))
            up = scratch.table(up, "roots")
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        up = up.select("tree", "parent", F.col("turn").alias("more"))
        labels = labels.join(up.hint("merge"), "tree", "left").select("pt_id", F.coalesce("parent", "tree").alias("tree"), (F.col("turn") * F.coalesce("more", F.lit(1))).alias("turn"))
    first = labels.groupBy("tree").agg(F.min(F.struct("pt_id", "turn")).alias("x")).select("tree", F.col("x.turn").alias("base"))
    out = own.join(labels.join(first.hint("merge"), "tree").hint("merge"), "pt_id").withColumn("size", norm(F.col("n")) + 1e-8)
    out = materialize(out.select("pt_id", scale(F.col("n"), F.col("turn") * F.col("base") / F.col("size")).alias("n")), "oriented")
    scratch.clear()
    return out


def grid_box(points: DataFrame, cells: int, pad: float) -> DataFrame:
    """One row: low and step of a grid of so many samples an axis around the points."""
    box = points.agg(*(f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    return box.select(vec(*(F.col(f"lo{a}") - pad for a in "xyz")).alias("low"), vec(*((F.col(f"hi{a}") - F.col(f"lo{a}") + 2 * pad) / (cells - 1) for a in "xyz")).alias("step"))


def signed_distances(points: DataFrame, cells: int = 64, k: int = 10, pad: float = 0.1) -> DataFrame:
    """ix, iy, iz, tsdf: on a grid around points (pt_id, x, y, z, n), the distance along the normals of the k nearest points.

    Nearer ones weigh more, by a bell curve as wide as a cell along x (the box's side over the number of samples).
    """
    box = grid_box(points, cells, pad)
    at = points.sparkSession.range(cells**3).select((-1 - F.col("id")).alias("pt_id"), *(F.floor(F.col("id") / cells**j).cast("long") % cells for j in (2, 1, 0))).toDF("pt_id", *AXES)
    grid = at.crossJoin(F.broadcast(box)).select("pt_id", *AXES, *((F.col("low")[j] + F.col(a) * F.col("step")[j]).alias(a[1]) for j, a in enumerate(AXES)), F.col("step")[0].alias("step"))
    near = neighbours(points.select("pt_id", *"xyz"), k, queries=grid.select("pt_id", *"xyz"))
    own = points.select(F.col("pt_id").alias("nn_id"), vec(*(F.col(a) for a in "xyz")).alias("p"), "n")
    d = near.join(own, "nn_id").join(grid, "pt_id").where("d >= 1e-8")
    width = F.col("step") * (cells - 1) / cells
    d = d.withColumn("w", F.exp(-F.col("d") * F.col("d") / (2 * width * width))).withColumn("s", dot(sub(vec(*(F.col(a) for a in "xyz")), F.col("p")), F.col("n")))
    sums = d.groupBy(*AXES).agg((F.sum(F.col("w") * F.col("s")) / (F.sum("w") + 1e-8)).alias("tsdf"))
    return at.select(*AXES).join(sums, list(AXES), "left").select(*AXES, F.coalesce("tsdf", F.lit(0.0)).alias("tsdf"))


def blurred(grid: DataFrame, cells: int, sigma: float = 1.0) -> DataFrame:
    """A whole grid smoothed by a bell curve along one axis after the other, cut at four deviations and mirrored at the sides."""
    reach = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-reach, reach + 1)]
    shares = F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w / sum(weights)).alias("w")) for o, w in zip(range(-reach, reach + 1), weights, strict=True)))
    for a in AXES:
        # each cell is asked by the cells at an offset; those beyond a side ask the mirrored cell
        d = grid.select(*(c for c in AXES if c != a), F.col(a).alias("from"), "tsdf").withColumn("x", F.explode(shares))
        images = F.array(F.col("from"), -F.col("from") - 1, 2 * cells - 1 - F.col("from"))
        d = d.withColumn("to", F.explode(images)).withColumn(a, F.col("to") - F.col("x.o")).where(F.col(a).between(0, cells - 1))
        grid = d.groupBy(*AXES).agg(F.sum(F.col("tsdf") * F.col("x.w")).alias("tsdf"))
    return grid


def surface(points: DataFrame, cells: int = 64, k: int = 10, pad: float = 0.1, sigma: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of the zero surface of the smoothed signed distances of points (pt_id, x, y, z, n)."""
    faces, vertices = extract_mesh(blurred(signed_distances(points, cells, k, pad), cells, sigma), 1.0)
    placed = vertices.crossJoin(F.broadcast(grid_box(points, cells, pad)))
    return faces, placed.select("vid", *((F.col("low")[j] + F.col(a) * F.col("step")[j]).alias(a) for j, a in enumerate("xyz")))
