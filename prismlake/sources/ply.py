"""ASCII PLY point clouds: a reader on Spark's text source and a writer of ordered text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TYPES = {"char": "short", "uchar": "short", "int8": "short", "uint8": "short", "short": "int", "ushort": "int", "int": "int", "uint": "long", "float": "double", "double": "double", "float32": "double", "float64": "double"}


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value of a text file, or of a folder's files in the order of their names, read in as many parts as there are splits.

    Lines are numbered within each split, and the splits' counts are summed up by their places.
    """
    place = ["file", "block"]
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    sizes = rows.groupBy(*place).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy(F.lit(0)).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(sizes, place).select((F.col("before") + F.col("id") - F.col("first")).alias("line"), "value")


def _header(lines: DataFrame) -> tuple[int, list[tuple[str, str]], int]:
    """Lines of the header, the vertices' properties and their number."""
    end = lines.where(F.trim("value") == "end_header").agg(F.min("line").alias("line")).first().line
    if end is None:
        raise ValueError("not a PLY file: its header has no end")
    head = [r.value.strip() for r in lines.where(F.col("line") <= end).orderBy("line").collect()]
    if head[0] != "ply" or "format ascii 1.0" not in head:
        raise ValueError("not an ASCII PLY file")
    props, element, n = [], None, 0
    for x in (line.split() for line in head):
        if x[:1] == ["element"]:
            element, n = x[1], int(x[2]) if x[1] == "vertex" else n
        elif x[:1] == ["property"] and element == "vertex" and x[1] != "list":
            props.append((x[2], TYPES[x[1]]))
    return len(head), props, n


def read_ply(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """The vertices of a file, or of a folder that write_ply() wrote, with its properties as columns, and vid, their places, if numbered; faces, which come behind them, are read by read_ply_faces()."""
    lines = lines_of(spark, path)
    skip, props, n = _header(lines)
    part = F.split(F.trim("value"), r"\s+")
    vid = [(F.col("line") - skip).alias("vid")] if numbered else []
    return lines.where((F.col("line") >= skip) & (F.col("line") < skip + n)).select(*vid, *(part[k].cast(kind).alias(name) for k, (name, kind) in enumerate(props)))


def read_ply_faces(spark: SparkSession, path: str) -> DataFrame:
    """fid (from 0) and vertices, an array of their places, of the lines behind the vertices."""
    lines = lines_of(spark, path)
    skip, _, n = _header(lines)
    part = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.col("line") >= skip + n) & (F.trim("value") != ""))
    return rows.select((F.col("line") - skip - n).alias("fid"), F.transform(F.slice(part, F.lit(2), F.coalesce(part[0].try_cast("int"), F.lit(0))), lambda x: x.try_cast("long")).alias("vertices"))


def ply_lines(points: DataFrame, order: str, digits: int = 6) -> DataFrame:
    """value: the body lines in order, x y z with the digits given, then colours r g b where there are any."""
    numbers = [F.format_string(f"%.{digits}f", F.col(c).cast("double")) for c in "xyz"]
    colours = [F.greatest(F.lit(0), F.least(F.lit(255), F.col(c).cast("int"))).cast("string") for c in "rgb"] if {"r", "g", "b"} <= set(points.columns) else []
    return points.select(order, F.concat_ws(" ", *numbers, *colours).alias("value")).orderBy(order).select("value")


def write_ply(points: DataFrame, path: str, order: str, binary: bool = False) -> None:
    """A folder of text parts in order; part 0 begins with the header, so that their concatenation is the file."""
    if binary:
        raise ValueError("only ASCII files are written")
    colours = ["property uchar red", "property uchar green", "property uchar blue"] if {"r", "g", "b"} <= set(points.columns) else []
    head = ["ply", "format ascii 1.0", f"element vertex {points.count()}", "property double x", "property double y", "property double z", *colours, "end_header"]
    spark = points.sparkSession
    top = spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1)
    top.unionByName(ply_lines(points, order)).write.text(path)
