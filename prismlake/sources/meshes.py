"""Mesh files: OBJ and PLY in lines, read in splits and written as ordered parts, and their statistics as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.meshes import quality
from ..session import materialize
from .ply import lines_of, read_ply, read_ply_faces


def placed(rows: DataFrame, order: str) -> DataFrame:
    """Adds place, from 0, by order: rows are sorted in ranges, and only the ranges' counts are summed up."""
    d = materialize(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()), "placed").withColumn("_part", F.shiftright("_id", 33))
    runs = d.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    runs = runs.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return d.join(runs, "_part").withColumn("place", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def _corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """fid and the places of the corners; vertices have place."""
    out = faces.select("fid", "a", "b", "c")
    for c in "abc":
        out = out.join(vertices.select(F.col("vid").alias(c), F.col("place").alias(f"p{c}")), c)
    return out.select("fid", "pa", "pb", "pc")


def _numbers(*columns: str) -> Column:
    return F.concat_ws(" ", *(F.format_string("%.6f", F.col(c).cast("double")) for c in columns))


def write_obj(faces: DataFrame, vertices: DataFrame, path: str) -> None:
    """A folder of text parts in order, whose concatenation is the file: vertices by vid, normals (nx, ny, nz) if there are any, then faces by fid."""
    v = placed(vertices, "vid")
    normals = {"nx", "ny", "nz"} <= set(vertices.columns)
    lines = v.select(F.lit(0).alias("kind"), F.col("place").alias("at"), F.concat(F.lit("v "), _numbers("x", "y", "z")).alias("value"))
    if normals:
        lines = lines.unionByName(v.select(F.lit(1).alias("kind"), F.col("place").alias("at"), F.concat(F.lit("vn "), _numbers("nx", "ny", "nz")).alias("value")))
    corner = (lambda c: F.concat_ws("//", F.col(c) + 1, F.col(c) + 1)) if normals else (lambda c: (F.col(c) + 1).cast("string"))
    f = _corners(faces, v).select(F.lit(2).alias("kind"), F.col("fid").cast("long").alias("at"), F.concat_ws(" ", F.lit("f"), *(corner(f"p{c}") for c in "abc")).alias("value"))
    lines.unionByName(f).orderBy("kind", "at").select("value").write.text(path)


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices): fid, a, b, c and vid, x, y, z, and nx, ny, nz where there are normals for all. Ids are places; polygons become fans of triangles.

    Indices count from 1, or from the end if negative. Texture coordinates, groups and materials are passed over.
    """
    lines = materialize(lines_of(spark, path).withColumn("part", F.split(F.trim("value"), r"\s+")), "obj")
    of = lambda kind, names: placed(lines.where(F.col("part")[0] == kind), "line").select(F.col("place").alias("vid"), *(F.col("part")[i + 1].try_cast("double").alias(n) for i, n in enumerate(names)))
    vertices, normals = of("v", "xyz"), of("vn", ("nx", "ny", "nz"))
    n = vertices.count()
    if n and normals.count() == n:
        vertices = vertices.join(normals, "vid")
    index = F.transform(F.slice("part", F.lit(2), F.size("part") - 1), lambda x: F.split(x, "/")[0].try_cast("long"))
    f = placed(lines.where(F.col("part")[0] == "f"), "line").select("place", F.transform(index, lambda i: F.when(i < 0, i + n).otherwise(i - 1)).alias("at"))
    f = f.select("place", "at", F.explode(F.sequence(F.lit(2), F.size("at") - 1)).alias("k")).where("k >= 2 AND size(at) > 2")
    f = f.select("place", "k", F.col("at")[0].alias("a"), F.element_at("at", F.col("k")).alias("b"), F.element_at("at", F.col("k") + 1).alias("c")).withColumn("order", F.struct("place", "k"))
    faces = placed(f, "order").select(F.col("place").alias("fid"), "a", "b", "c")
    return faces, vertices


def write_ply_mesh(faces: DataFrame, vertices: DataFrame, path: str) -> None:
    """A folder of text parts in order, whose concatenation is an ASCII PLY file: vertices by vid, normals and colours (r, g, b) if there are any, faces by fid."""
    v = placed(vertices, "vid")
    have, columns, props = set(vertices.columns), ["x", "y", "z"], ["double x", "double y", "double z"]
    if {"nx", "ny", "nz"} <= have:
        columns, props = [*columns, "nx", "ny", "nz"], [*props, "double nx", "double ny", "double nz"]
    body = [_numbers(*columns)]
    if {"r", "g", "b"} <= have:
        props += ["uchar red", "uchar green", "uchar blue"]
        body += [F.greatest(F.lit(0), F.least(F.lit(255), F.col(c).cast("int"))).cast("string") for c in "rgb"]
    head = ["ply", "format ascii 1.0", f"element vertex {vertices.count()}", *(f"property {p}" for p in props), f"element face {faces.count()}", "property list uchar int vertex_indices", "end_header"]
    lines = vertices.sparkSession.createDataFrame([(0, k, line) for k, line in enumerate(head)], "kind int, at long, value string")
    lines = lines.unionByName(v.select(F.lit(1).alias("kind"), F.col("place").alias("at"), F.concat_ws(" ", *body).alias("value")))
    f = _corners(faces, v).select(F.lit(2).alias("kind"), F.col("fid").cast("long").alias("at"), F.concat_ws(" ", F.lit("3"), "pa", "pb", "pc").alias("value"))
    lines.unionByName(f).orderBy("kind", "at").select("value").write.text(path)


def read_mesh(spark: SparkSession, path: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(faces, vertices) of an OBJ or ASCII PLY file or folder; kind: obj or ply, by default as the path ends."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "obj":
        return read_obj(spark, path)
    if kind != "ply":
        raise ValueError(f"no mesh files of kind {kind}")
    vertices = read_ply(spark, path, numbered=True)
    f = read_ply_faces(spark, path).withColumn("k", F.explode(F.sequence(F.lit(2), F.size("vertices") - 1))).where("k >= 2 AND size(vertices) > 2")
    f = f.select(F.struct("fid", "k").alias("order"), F.col("vertices")[0].alias("a"), F.element_at("vertices", F.col("k")).alias("b"), F.element_at("vertices", F.col("k") + 1).alias("c"))
    return placed(f, "order").select(F.col("place").alias("fid"), "a", "b", "c"), vertices


def write_mesh_stats(faces: DataFrame, vertices: DataFrame, path: str) -> None:
    """The mesh's quality as a JSON line."""
    quality(faces, vertices).coalesce(1).write.json(path)
