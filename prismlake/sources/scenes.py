"""Scenes on disk: images, camera files, and datasets of rays with the colours of their pixels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cameras import from_backward_pose
from ..operators.scenes import image_rays

#: Size of images that can't be told, and pixels to a batch.
DEFAULT_SIZE, SLICE = (640, 480), 65_536

CAMERAS = "K array<array<double>>, poses map<string,struct<R:array<array<double>>,t:array<array<double>>,image:string>>"
TRANSFORMS = "camera_angle_x double, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>"


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """name, width, height, channels, data (bytes, blue first) of the images of a folder, or of one; files that are none are passed over."""
    d = spark.read.format("image").option("dropInvalid", True).load(path)
    return d.select(F.element_at(F.split("image.origin", "/"), -1).alias("name"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), "image.data")


def image_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """(width, height) of the first image of a folder by name, or DEFAULT_SIZE."""
    first = read_images(spark, path).select("name", "width", "height").orderBy("name").first()
    return (first.width, first.height) if first else DEFAULT_SIZE


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            x = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"])
            bgr = np.repeat(x, 3, axis=2) if r["channels"] == 1 else x[:, :, :3]
            flat = bgr.reshape(-1, 3).astype(np.int32)
            for at in range(0, len(flat), SLICE):
                part, place = flat[at : at + SLICE], np.arange(at, min(at + SLICE, len(flat)))
                yield pa.RecordBatch.from_arrays([pa.array([r["name"]] * len(part)), pa.array((place // r["width"]).astype(np.int32)), pa.array((place % r["width"]).astype(np.int32)), *(pa.array(part[:, k]) for k in (2, 1, 0))], names=["name", "row", "col", "r", "g", "b"])


def image_pixels(images: DataFrame) -> DataFrame:
    """name, row, col, r, g, b (0 to 255) of every pixel of read_images()."""
    return images.select("name", "width", "height", "channels", "data").mapInArrow(_rows, "name string, row int, col int, r int, g int, b int")


def read_camera_file(spark: SparkSession, path: str) -> DataFrame:
    """img_id, name, R, t, K of the cameras of a reconstruction's JSON file: K, and poses by number."""
    d = spark.read.schema(CAMERAS).json(path, multiLine=True).select(F.flatten("K").alias("K"), F.explode("poses").alias("key", "pose"))
    return d.select(F.col("key").cast("long").alias("img_id"), F.col("pose.image").alias("name"), F.flatten("pose.R").alias("R"), F.flatten("pose.t").alias("t"), "K")


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """img_id (the frame's place), name, angle, R, t of a file of camera-to-world matrices that look along -z."""
    d = spark.read.schema(TRANSFORMS).json(path, multiLine=True).select("camera_angle_x", F.posexplode("frames").alias("img_id", "frame"))
    d = d.select(F.col("img_id").cast("long").alias("img_id"), F.element_at(F.split("frame.file_path", "/"), -1).alias("name"), F.col("camera_angle_x").alias("angle"), F.flatten("frame.transform_matrix").alias("m"))
    r, t = from_backward_pose(F.col("m"))
    return d.select("img_id", "name", "angle", r.alias("R"), t.alias("t"))


def dataset_rays(cameras: DataFrame, images: DataFrame, focal: float | None = None, angle: float | None = None) -> DataFrame:
    """img_id, row, col, origin, direction, r, g, b (0 to 1) of all pixels of the cameras' images, which are all of one size.

    cameras: img_id, name, R, t and, without focal and angle, K. A name matches an image's with or without its ending.
    """
    size = images.select("width", "height").first()
    if size is None:
        raise ValueError("a dataset without images")
    width, height = size
    if focal or angle:
        rays = image_rays(cameras, width, height, focal or width / 2 / math.tan(angle / 2), width / 2, height / 2)
    else:
        k = cameras.select("K").first().K
        rays = image_rays(cameras, width, height, k[0], k[2], k[5], k[4])
    bare = lambda c: F.regexp_replace(c, r"\.[A-Za-z]+$", "")
    names = cameras.select("img_id", bare("name").alias("name"))
    pixels = image_pixels(images.where((F.col("width") == width) & (F.col("height") == height))).withColumn("name", bare("name")).join(names, "name")
    return rays.join(pixels.select("img_id", "row", "col", *((F.col(c) / 255.0).alias(c) for c in "rgb")), ["img_id", "row", "col"])


def read_jobs(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """job_id and status of the status.json of every job's folder under path; what is known of a job counts more, files that can't be read don't."""
    schema = "job_id string, status string, _broken string"
    found = spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="status.json", recursiveFileLookup=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken")
    found = found.select(F.coalesce("job_id", F.element_at(F.split(F.input_file_name(), "/"), -2)).alias("job_id"), "status", "_broken").where("_broken IS NULL AND status IS NOT NULL").drop("_broken")
    if known is None:
        return found
    return known.select("job_id", "status").unionByName(found.join(known.select("job_id"), "job_id", "left_anti"))
