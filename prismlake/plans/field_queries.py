"""Queries of a small radiance field of fixed weights: parts pose as rays. The SQL is written from the weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linear import norm, scale, tidy, vec
from ..operators import cameras as C
from ..operators import fields as R
from ..operators import paths as W
from ..session import table
from .fixtures import CAMERAS, cameras, with_
from .registry import register

FIELD = R.Field.drawn(1, 0, 4, 2, 1, seed=5)
NEAR, FAR, COARSE, FINE = 1.0, 4.0, 6, 4

RAYS = """
turned AS (SELECT p_partkey AS ray_id, (p_size - 25) / 50.0::DOUBLE AS ox, (p_partkey % 7) / 10.0::DOUBLE AS oy, (p_retailprice - 1500) / 1000.0::DOUBLE AS oz, cos(p_partkey::DOUBLE) AS a, sin(p_partkey::DOUBLE) AS b FROM part),
rays AS (SELECT ray_id, ox, oy, oz, a / sqrt(a * a + b * b + 0.25) AS dx, b / sqrt(a * a + b * b + 0.25) AS dy, 0.5 / sqrt(a * a + b * b + 0.25) AS dz FROM turned)"""


def _row(w: np.ndarray, b: float, h: str) -> str:
    return f"list_dot_product({h}, [{', '.join(f'{float(x)!r}' for x in w)}]::DOUBLE[]) + {float(b)!r}"


def _layer(layer: R.Layer, h: str, wrap: str = "greatest(0.0, {})") -> str:
    return "[" + ", ".join(wrap.format(_row(w, b, h)) for w, b in zip(*layer, strict=True)) + "]"


def network(name: str, source: str) -> str:
    """CTEs that add r, g, b, sigma of FIELD to ray_id, z of source."""
    stages = [f"{name}_0 AS (SELECT ray_id, z, [ox + dx * z, oy + dy * z, oz + dz * z] AS x, [dx, dy, dz] AS d FROM {source} JOIN rays USING (ray_id))"]
    stages.append(f"{name}_1 AS (SELECT *, list_concat(x, [sin(x[1]), sin(x[2]), sin(x[3]), cos(x[1]), cos(x[2]), cos(x[3])]) AS p FROM {name}_0)")
    h = "p"
    for k, layer in enumerate(FIELD.layers):
        into = f"list_concat({h}, p)" if k and k == FIELD.skip else h
        stages.append(f"{name}_{k + 2} AS (SELECT ray_id, z, d, p, {_layer(layer, into)} AS h FROM {name}_{k + 1})")
        h = "h"
    last = f"{name}_{len(FIELD.layers) + 1}"
    stages.append(f"{name}_c AS (SELECT ray_id, z, {_layer(FIELD.density, 'h')} AS s, list_concat({_layer(FIELD.feature, 'h', '{}')}, d) AS f FROM {last})")
    stages.append(f"{name}_d AS (SELECT ray_id, z, s[1] AS sigma, {_layer(FIELD.colour[0], 'f')} AS f FROM {name}_c)")
    stages.append(f"{name}_e AS (SELECT ray_id, z, sigma, {_layer(FIELD.colour[1], 'f', '1 / (1 + exp(-({})))')} AS c FROM {name}_d)")
    stages.append(f"{name}_a AS (SELECT *, 1 - exp(-sigma * coalesce(lead(z) OVER (PARTITION BY ray_id ORDER BY z) - z, 1e10)) AS alpha FROM {name}_e)")
    stages.append(f"{name} AS (SELECT *, alpha * exp(coalesce(sum(ln(1 - alpha + 1e-10)) OVER (PARTITION BY ray_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS w FROM {name}_a)")
    return ",\n".join(stages)


COARSE_Z = "start AS (SELECT ray_id, 1.0::DOUBLE + 3.0 * i / 5 AS z FROM rays, range(0, 6) k(i))"
FINE_Z = """
lists AS (SELECT ray_id, list(z ORDER BY z) AS z, list(w ORDER BY z) AS w FROM coarse GROUP BY 1),
parts AS (SELECT ray_id, z, [(z[i] + z[i + 1]) / 2 FOR i IN range(1, 6)] AS m, [(x + 1e-5) / list_sum([y + 1e-5 FOR y IN w[2:5]]) FOR x IN w[2:5]] AS p FROM lists),
sums AS (SELECT *, [coalesce(list_sum(p[1:i]), 0) FOR i IN range(0, 5)] AS cdf FROM parts),
draws AS (SELECT *, j / 3.0::DOUBLE AS u, greatest(1, least(4, len([c FOR c IN cdf IF c <= j / 3.0::DOUBLE]))) AS k FROM sums, range(0, 4) t(j)),
more AS (SELECT ray_id, z FROM start UNION ALL SELECT ray_id, m[k] + (u - cdf[k]) / CASE WHEN cdf[k + 1] - cdf[k] < 1e-5 THEN 1.0 ELSE cdf[k + 1] - cdf[k] END * (m[k + 1] - m[k]) FROM draws)"""
LIT = "ray_id, round(sum(w * c[1]) + 1 - sum(w), 4) + 0.0 AS r_{0}, round(sum(w * c[2]) + 1 - sum(w), 4) + 0.0 AS g_{0}, round(sum(w * c[3]) + 1 - sum(w), 4) + 0.0 AS b_{0}, round(sum(w * z), 4) + 0.0 AS depth_{0}, round(sum(w), 4) + 0.0 AS acc_{0}"


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    d = vec(F.cos(k.cast("double")), F.sin(k.cast("double")), 0.5)
    p = table(spark, sf_dir, "part").withColumn("d", d)
    return p.select(k.alias("ray_id"), vec((F.col("p_size") - 25) / 50.0, k % 7 / 10.0, (F.col("p_retailprice") - 1500) / 1000.0).alias("origin"), scale(F.col("d"), 1 / norm(F.col("d"))).alias("direction"))


@register("n6_field", with_(RAYS, COARSE_Z, network("coarse", "start")) + "SELECT ray_id, round(z, 4) + 0.0 AS z, round(c[1], 5) + 0.0 AS r, round(c[2], 5) + 0.0 AS g, round(c[3], 5) + 0.0 AS b, round(sigma, 5) + 0.0 AS sigma FROM coarse")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rays(spark, sf_dir).withColumn("z", R.stratified_depths(F.lit(NEAR), F.lit(FAR), COARSE))
    return R.evaluate(R._samples(d), FIELD).select("ray_id", tidy(F.col("z"), 4).alias("z"), *(tidy(F.col(c), 5).alias(c) for c in ("r", "g", "b", "sigma")))


@register(
    "n12_render_rays",
    with_(RAYS, COARSE_Z, network("coarse", "start"), FINE_Z, network("fine", "more")) + f"SELECT * FROM (SELECT {LIT.format('coarse')} FROM coarse GROUP BY 1) JOIN (SELECT {LIT.format('fine')} FROM fine GROUP BY 1) USING (ray_id)",
)
def render_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.render_rays(rays(spark, sf_dir), FIELD, NEAR, FAR, COARSE, FINE)
    return d.select("ray_id", *(tidy(F.col(f"{c}_{kind}"), 4).alias(f"{c}_{kind}") for kind in ("coarse", "fine") for c in ("r", "g", "b", "depth", "acc")))


@register(
    "r11_key_frame_path",
    with_(CAMERAS)
    + """, k AS (SELECT row_number() OVER (ORDER BY img_id) - 1 AS i, count(*) OVER () AS n, * FROM cameras JOIN centers USING (img_id)),
f AS (SELECT f.frame, f.frame * (n - 1)::DOUBLE / (2 * n - 1) AS tm, n FROM (SELECT DISTINCT n FROM k) s, range(0, 2 * s.n) f(frame)),
s AS (SELECT f.frame, tm, least(floor(tm)::BIGINT, f.n - 2) AS i FROM f)
SELECT frame, round(a.c0 + (tm - s.i) * (b.c0 - a.c0), 5) + 0.0 AS x, round(a.c1 + (tm - s.i) * (b.c1 - a.c1), 5) + 0.0 AS y, round(a.c2 + (tm - s.i) * (b.c2 - a.c2), 5) + 0.0 AS z FROM s JOIN k a ON a.i = s.i JOIN k b ON b.i = s.i + 1""",
)
def key_frame_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice as many frames as there are cameras, on a path through them."""
    cams = cameras(spark, sf_dir)
    path = W.key_frame_path(cams, 2 * cams.count(), "img_id")
    return path.select("frame", *(tidy(C.center(F.col("R"), F.col("t"))[i], 5).alias(a) for i, a in enumerate("xyz")))
