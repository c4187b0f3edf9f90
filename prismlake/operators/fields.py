"""Radiance fields: a small network over encoded positions and directions, and rays rendered coarse to fine.

A field's weights go to every worker once, by a broadcast of checked size. Samples stay rows: the network
runs over Arrow batches in slices, light is summed by windows over a ray's samples, and the finer samples
come from the coarse weights by expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, materialize
from .rendering import chance, composite, encoded_size, inverse_cdf, jittered_depths, stratified_depths, weighted
from .scenes import image_rays

#: Bytes of weights at most, and rows that go through the network at once.
MOST_BYTES, SLICE = 64 << 20, 32_768

Layer = tuple[np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Field:
    """A network: layers over the encoded position, of which the one at skip sees it again; then density, a feature, and colour by direction. Layers are (weights out x in, offsets)."""

    position_levels: int
    direction_levels: int
    layers: tuple[Layer, ...]
    density: Layer
    feature: Layer
    colour: tuple[Layer, Layer]
    skip: int | None = None

    @property
    def size(self) -> int:
        return sum(w.nbytes + b.nbytes for w, b in (*self.layers, self.density, self.feature, *self.colour))

    @staticmethod
    def drawn(position_levels: int = 10, direction_levels: int = 4, hidden: int = 256, layers: int = 8, skip: int | None = 4, seed: int = 0) -> Field:
        """A field with random weights."""
        rng = np.random.default_rng(seed)

        def layer(out: int, into: int) -> Layer:
            reach = into**-0.5
            return rng.uniform(-reach, reach, (out, into)), rng.uniform(-reach, reach, out)

        p, d = encoded_size(3, position_levels), encoded_size(3, direction_levels)
        stack = tuple(layer(hidden, (p if k == 0 else hidden) + (p if k and k == skip else 0)) for k in range(layers))
        return Field(position_levels, direction_levels, stack, layer(1, hidden), layer(hidden, hidden), (layer(hidden // 2, hidden + d), layer(3, hidden // 2)), skip)

    @staticmethod
    def small(position_levels: int = 6, direction_levels: int = 2, hidden: int = 128, seed: int = 0) -> Field:
        """Four layers, none of which sees the position again."""
        return Field.drawn(position_levels, direction_levels, hidden, 4, None, seed)

    def __call__(self, positions: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(colours from 0 to 1, densities not below 0) of n x 3 positions and unit directions."""
        p, d = encoded(positions, self.position_levels), encoded(directions, self.direction_levels)
        h = p
        for k, (w, b) in enumerate(self.layers):
            h = np.maximum((np.hstack([h, p]) if k and k == self.skip else h) @ w.T + b, 0)
        sigma = np.maximum(h @ self.density[0].T + self.density[1], 0)[:, 0]
        c = np.hstack([h @ self.feature[0].T + self.feature[1], d])
        c = np.maximum(c @ self.colour[0][0].T + self.colour[0][1], 0) @ self.colour[1][0].T + self.colour[1][1]
        return 0.5 * (1 + np.tanh(c / 2)), sigma


def encoded(x: np.ndarray, levels: int) -> np.ndarray:
    """x, then all sines and all cosines of each level."""
    return np.hstack([x, *(f(2.0**k * x) for k in range(levels) for f in (np.sin, np.cos))])


def evaluate(samples: DataFrame, field: Field) -> DataFrame:
    """Adds r, g, b and sigma to samples with x, y, z positions px, py, pz and directions dx, dy, dz."""
    if field.size > MOST_BYTES:
        raise ValueError(f"a field of {field.size} bytes; at most {MOST_BYTES} are broadcast")
    sent = samples.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.slice(at, SLICE)
                p, d = (np.column_stack([np.array(batch.column(f"{kind}{a}"), float) for a in "xyz"]) for kind in "pd")
                rgb, sigma = sent.value(p, d)
                for name, column in (("r", rgb[:, 0]), ("g", rgb[:, 1]), ("b", rgb[:, 2]), ("sigma", sigma)):
                    batch = batch.append_column(name, pa.array(column))
                yield batch

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields)
    return samples.mapInArrow(run, f"{kept}, r double, g double, b double, sigma double")


def _samples(rays: DataFrame) -> DataFrame:
    """A row for each depth in z of rays (ray_id, origin, direction)."""
    d = rays.withColumn("z", F.explode("z"))
    return d.select("ray_id", "z", *((F.col("origin")[i] + F.col("direction")[i] * F.col("z")).alias(f"p{a}") for i, a in enumerate("xyz")), *(F.col("direction")[i].alias(f"d{a}") for i, a in enumerate("xyz")))


def render_rays(rays: DataFrame, field: Field, near: Column | float, far: Column | float, coarse: int = 64, fine: int = 128, fine_field: Field | None = None, white: bool = True, seed: int | None = None) -> DataFrame:
    """ray_id and, for coarse and (if fine > 0) fine samples, colour, depth and opacity: r_coarse ... acc_fine.

    rays: ray_id, origin, direction (of length 1). Fine samples are drawn where the coarse ones have weight,
    and join them. seed: depths are jittered by it; None: they are even. A ray's samples are in one task.
    """
    scratch, key = Scratch(rays.sparkSession), F.col("ray_id")
    bounds = [b if isinstance(b, Column) else F.lit(float(b)) for b in (near, far)]
    z = stratified_depths(*bounds, coarse) if seed is None else jittered_depths(*bounds, coarse, seed, key)
    d = scratch.table(rays.select("ray_id", "origin", "direction", z.alias("z")), "rays")
    names = ("r", "g", "b", "depth", "acc")
    first = scratch.table(evaluate(_samples(d), field), "coarse")
    out = composite(first, white=white).select("ray_id", *(F.col(c).alias(f"{c}_coarse") for c in names))
    if fine > 0:
        lit = weighted(first).groupBy("ray_id").agg(F.array_sort(F.collect_list(F.struct("z", "_w"))).alias("s"))  # as many as coarse samples
        middles = F.transform(F.sequence(F.lit(1), F.lit(coarse - 1)), lambda k: (F.element_at("s", k)["z"] + F.element_at("s", k + 1)["z"]) / 2)
        inner = F.transform(F.slice("s", 2, coarse - 2), lambda x: x["_w"])
        draws = F.transform(F.sequence(F.lit(0), F.lit(fine - 1)), lambda k: k / max(1, fine - 1) if seed is None else chance(seed + 1, key, k))
        more = lit.select("ray_id", "s", middles.alias("m"), inner.alias("w"), draws.alias("u"))
        more = more.select("ray_id", F.concat(F.transform("s", lambda x: x["z"]), F.transform("u", lambda u: inverse_cdf(F.col("m"), F.col("w"), u))).alias("z"))
        second = evaluate(_samples(d.drop("z").join(more, "ray_id")), fine_field or field)
        out = out.join(composite(second, white=white).select("ray_id", *(F.col(c).alias(f"{c}_fine") for c in names)), "ray_id")
    out = materialize(out, "rendered")
    scratch.clear()
    return out


def render_images(cameras: DataFrame, width: int, height: int, focal: float, field: Field, near: float, far: float, **how) -> DataFrame:
    """img_id, row, col and what render_rays() gives for every pixel of the cameras' images, centred in the middle."""
    rays = image_rays(cameras, width, height, focal, width / 2, height / 2)
    rays = rays.select(F.struct("img_id", "row", "col").alias("ray_id"), "origin", "direction")
    return render_rays(rays, field, near, far, **how).select("ray_id.*", "*").drop("ray_id")

