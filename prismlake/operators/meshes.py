"""Triangle meshes as tables: vertices (vid, x, y, z) and faces (fid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linear import cross, dot, norm, sub, vec
from ..session import materialize
from .components import components


def edges(faces: DataFrame) -> DataFrame:
    """Every face's three edges, low vertex first."""
    pairs = F.explode(F.array(*(F.struct(F.least(p, q).alias("lo"), F.greatest(p, q).alias("hi")) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))))
    return faces.select("fid", pairs.alias("e")).select("fid", "e.lo", "e.hi")


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid and the positions pa, pb, pc: one join of exploded corners, gathered by face."""
    long = faces.select("fid", F.posexplode(F.array("a", "b", "c")).alias("k", "vid"))
    placed = long.join(vertices.select("vid", vec(F.col("x"), F.col("y"), F.col("z")).alias("p")), "vid")
    return placed.groupBy("fid").agg(*(F.max(F.when(F.col("k") == i, F.col("p"))).alias(n) for i, n in enumerate(("pa", "pb", "pc"))))


def quality(faces: DataFrame, vertices: DataFrame, tiny: float = 1e-10) -> DataFrame:
    """Counts, area, degenerate faces, mean edge length, watertightness, Euler number, volume if watertight."""
    n = cross(sub(F.col("pb"), F.col("pa")), sub(F.col("pc"), F.col("pa")))
    shape = corners(faces, vertices).withColumn("area", norm(n) / 2).withColumn("signed", dot(F.col("pa"), cross(F.col("pb"), F.col("pc"))) / 6)
    sums = shape.agg(F.count("*").alias("n_faces"), F.sum("area").alias("area"), F.count_if(F.col("area") < tiny).alias("n_degenerate"), F.sum("signed").alias("volume"))
    distinct = edges(faces).groupBy("lo", "hi").agg(F.count("*").alias("uses"))
    v = vertices.select("vid", "x", "y", "z")
    long = distinct.join(v.select(F.col("vid").alias("lo"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0")), "lo", "left").join(v.select(F.col("vid").alias("hi"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("z1")), "hi", "left")
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2 + (F.col("z1") - F.col("z0")) ** 2)
    rims = long.agg(F.count("*").alias("n_edges"), F.avg(length).alias("mean_edge"), F.min(F.col("uses") == 2).alias("watertight"))
    used = faces.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct().agg(F.count("*").alias("n_vertices"))
    out = sums.crossJoin(rims).crossJoin(used)
    return out.withColumn("euler", F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")).withColumn("volume", F.when(F.col("watertight"), F.abs("volume")))


def winding_consistent(faces: DataFrame) -> DataFrame:
    """consistent: whether no two faces run along an edge in the same direction; of no faces, true."""
    way = F.explode(F.array(*(F.struct(F.col(p).alias("p"), F.col(q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a")))))
    return faces.select(way.alias("e")).groupBy("e").count().agg(F.coalesce(F.max("count") <= 1, F.lit(True)).alias("consistent"))


def pieces(faces: DataFrame) -> DataFrame:
    """fid, component of every face: faces are neighbours where an edge has just these two, as in the reference's split."""
    shared = edges(faces).groupBy("lo", "hi").agg(F.count("*").alias("uses"), F.min("fid").alias("a"), F.max("fid").alias("b")).where("uses = 2")
    found = components(shared.select("a", "b")).withColumnRenamed("node", "fid")
    return faces.select("fid").join(found, "fid", "left").select("fid", F.coalesce("component", "fid").alias("component"))


def clean(faces: DataFrame, vertices: DataFrame, tiny: float = 1e-10, ratio: float = 0.01) -> DataFrame:
    """Faces without repeats of the same three vertices (the smallest fid stays) and without vanishing area, then
    without the components that have fewer faces than ratio times the largest; a ratio of 0 leaves all."""
    key = F.array_sort(F.array("a", "b", "c"))
    first = faces.withColumn("_key", key).groupBy("_key").agg(F.min(F.struct("fid", "a", "b", "c")).alias("f")).select("f.*")
    n = cross(sub(F.col("pb"), F.col("pa")), sub(F.col("pc"), F.col("pa")))
    good = corners(first, vertices).where(norm(n) / 2 >= tiny).select("fid")
    whole = first.join(good, "fid", "left_semi")
    if ratio <= 0:
        return whole
    whole = materialize(whole, "faces")
    labels = materialize(pieces(whole), "pieces")
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    large = sizes.crossJoin(F.broadcast(sizes.agg(F.max("n").alias("most")))).where(F.col("n") >= F.col("most") * ratio)
    return whole.join(labels.join(large, "component", "left_semi"), "fid", "left_semi")


def smooth(faces: DataFrame, vertices: DataFrame, share: float = 0.5, rounds: int = 1) -> DataFrame:
    """Moves each vertex towards the mean of its distinct neighbours; isolated ones stay."""
    e = edges(faces).select("lo", "hi").distinct()
    links = e.select(F.col("lo").alias("vid"), F.col("hi").alias("other")).unionByName(e.select(F.col("hi").alias("vid"), F.col("lo").alias("other")))
    now = vertices.select("vid", "x", "y", "z")
    for _ in range(rounds):
        mean = links.join(now.withColumnRenamed("vid", "other"), "other").groupBy("vid").agg(*(F.avg(a).alias(f"m{a}") for a in "xyz"))
        now = now.join(mean, "vid", "left").select("vid", *(((1 - share) * F.col(a) + share * F.coalesce(F.col(f"m{a}"), F.col(a))).alias(a) for a in "xyz"))
    return now


def decimate(faces: DataFrame, vertices: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Vertex clustering: (faces, vertices) with the vertices of a cell merged at their centroid, collapsed faces dropped."""
    cell = vertices.select("vid", "x", "y", "z", *(F.floor(F.col(a) / size).cast("long").alias(f"i{a}") for a in "xyz"))
    merged = cell.groupBy("ix", "iy", "iz").agg(F.min("vid").alias("new"), *(F.avg(a).alias(a) for a in "xyz"))
    to = cell.join(merged.select("ix", "iy", "iz", "new"), ["ix", "iy", "iz"]).select("vid", "new")
    out = faces
    for c in "abc":
        out = out.join(to.select(F.col("vid").alias(c), F.col("new").alias(f"n{c}")), c)
    out = out.select("fid", F.col("na").alias("a"), F.col("nb").alias("b"), F.col("nc").alias("c")).where("a <> b AND b <> c AND a <> c")
    return out, merged.select(F.col("new").alias("vid"), "x", "y", "z")
