"""Rays, encodings and volume rendering as expressions and windows over a ray's samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.linear import dot, norm, scale, sub, vec

EDGE = 1e10


def pixel_direction(u: Column, v: Column, focal: Column | float, cx: float, cy: float) -> Column:
    """Unit direction of a pixel's ray in camera space."""
    d = vec((u - cx) / focal, (v - cy) / focal, 1)
    return scale(d, 1 / norm(d))


def box_hit(origin: Column, direction: Column, low: Column, high: Column) -> Column:
    """Distance at which a ray enters a box by slabs; -1 on a miss."""
    near, far = [], []
    for i in range(3):
        step = F.when(F.abs(direction[i]) < 1e-12, 1e-12).otherwise(direction[i])
        a, b = (low[i] - origin[i]) / step, (high[i] - origin[i]) / step
        near.append(F.least(a, b))
        far.append(F.greatest(a, b))
    enter, leave = F.greatest(*near), F.least(*far)
    return F.when((leave >= F.greatest(enter, F.lit(0.0))), F.when(enter > 0, enter).otherwise(leave)).otherwise(-1.0)


def sphere_hit(origin: Column, direction: Column, centre: Column, radius: Column | float) -> Column:
    """Nearest positive distance at which a ray of unit direction meets a sphere; -1 on a miss."""
    o = sub(origin, centre)
    b, c = dot(o, direction), dot(o, o) - radius * radius
    disc = b * b - c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    return F.when(disc < 0, -1.0).when(-b - root > 1e-6, -b - root).when(-b + root > 1e-6, -b + root).otherwise(-1.0)


def shade(normal: Column, light: Column, ambient: float = 0.25) -> Column:
    return ambient + (1 - ambient) * F.greatest(F.lit(0.0), dot(normal, light))


def encode(x: Column, levels: int, include: bool = True, linear: bool = False) -> Column:
    """x, then sin and cos of 2 ** k x for each level; linear: of frequencies evenly from 1 to the highest of these."""
    top = 2.0 ** (levels - 1)
    frequency = (lambda k: 1 + (top - 1) * k / max(1, levels - 1)) if linear else (lambda k: F.pow(F.lit(2.0), k))
    bands = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.array(F.sin(x * frequency(k)), F.cos(x * frequency(k)))))
    return F.concat(F.array(x), bands) if include else bands


def encoded_size(axes: int, levels: int, include: bool = True) -> int:
    """Numbers that encode() makes of so many axes."""
    return axes * (2 * levels + include)


def encode_integrated(x: Column, variance: Column, levels: int) -> Column:
    """All sines, then all cosines, damped by the variance under each frequency."""
    ks = F.sequence(F.lit(0), F.lit(levels - 1))
    damp = lambda k: F.exp(-0.5 * F.pow(F.lit(4.0), k) * variance)
    return F.concat(F.transform(ks, lambda k: F.sin(x * F.pow(F.lit(2.0), k)) * damp(k)), F.transform(ks, lambda k: F.cos(x * F.pow(F.lit(2.0), k)) * damp(k)))


def weighted(samples: DataFrame, ray: str = "ray_id", z: str = "z", sigma: str = "sigma") -> DataFrame:
    """Adds _w, the share of a ray's light that comes from each sample.

    Light left before a sample is the exponential of a running sum of logarithms: one window a ray, no
    unpartitioned window.
    """
    order = Window.partitionBy(ray).orderBy(z)
    step = F.coalesce(F.lead(z).over(order) - F.col(z), F.lit(EDGE))
    d = samples.withColumn("_alpha", 1 - F.exp(-F.greatest(F.col(sigma), F.lit(0.0)) * step))
    left = F.exp(F.coalesce(F.sum(F.ln(1 - F.col("_alpha") + 1e-10)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return d.withColumn("_w", F.col("_alpha") * left)


def composite(samples: DataFrame, ray: str = "ray_id", z: str = "z", sigma: str = "sigma", values: tuple[str, ...] = ("r", "g", "b"), white: bool = False) -> DataFrame:
    """Colour, depth and opacity of each ray from its samples in order of depth: one shuffle by ray for window and sum."""
    d = weighted(samples, ray, z, sigma)
    out = d.groupBy(ray).agg(*(F.sum(F.col("_w") * F.col(c)).alias(c) for c in values), F.sum(F.col("_w") * F.col(z)).alias("depth"), F.sum("_w").alias("acc"))
    return out.withColumns({c: F.col(c) + (1 - F.col("acc")) for c in values}) if white else out


def stratified_depths(near: Column, far: Column, n: int) -> Column:
    """n depths from near to far, evenly."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: near + (far - near) * k / (n - 1))


def chance(seed: int, *keys: Column) -> Column:
    """A number from 0 to 1, without it, that follows from keys and seed: reruns and retried tasks agree."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)


def jittered_depths(near: Column, far: Column, n: int, seed: int, *keys: Column) -> Column:
    """n depths from near to far, each drawn between the middles to the depths beside it; keys tell rays apart."""
    z = stratified_depths(near, far, n)

    def draw(x: Column, k: Column) -> Column:
        low = F.when(k > 0, (x + F.get(z, k - 1)) / 2).otherwise(x)
        high = F.when(k < n - 1, (x + F.get(z, k + 1)) / 2).otherwise(x)
        return low + (high - low) * chance(seed, *keys, k)

    return F.transform(z, draw)


def inverse_cdf(edges: Column, weights: Column, u: Column) -> Column:
    """Depth at which the weights' distribution reaches u: edges has one entry more than weights."""
    w = F.transform(weights, lambda x: x + 1e-5)
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
    cdf = F.aggregate(w, F.array(F.lit(0.0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + x / total))
    below = F.greatest(F.least(F.size(F.filter(cdf, lambda c: c <= u)), F.size(cdf) - 1), F.lit(1))
    a, b = F.element_at(cdf, below), F.element_at(cdf, below + 1)
    span = F.when(b - a < 1e-5, 1.0).otherwise(b - a)
    return F.element_at(edges, below) + (u - a) / span * (F.element_at(edges, below + 1) - F.element_at(edges, below))


def psnr(mse: Column) -> Column:
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(F.nullif(mse, F.lit(0.0))))
