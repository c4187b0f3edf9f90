"""Radiance fields and rays rendered through them, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import fields
from prismlake.operators import rendering as N


def light(z, rgb, sigma):
    """White-backed colour, depth, opacity and weights of one ray."""
    alpha = 1 - np.exp(-sigma * np.append(np.diff(z), 1e10))
    w = alpha * np.concatenate([[1], np.cumprod(1 - alpha + 1e-10)[:-1]])
    return (w[:, None] * rgb).sum(axis=0) + 1 - w.sum(), (w * z).sum(), w.sum(), w


def drawn(edges, weights, u):
    w = (weights + 1e-5) / (weights + 1e-5).sum()
    cdf = np.concatenate([[0], np.cumsum(w)])
    at = np.clip(np.searchsorted(cdf, u, side="right") - 1, 0, len(w) - 1)
    span = np.where(cdf[at + 1] - cdf[at] < 1e-5, 1.0, cdf[at + 1] - cdf[at])
    return edges[at] + (u - cdf[at]) / span * (edges[at + 1] - edges[at])


@pytest.fixture(scope="module")
def rays():
    rng = np.random.default_rng(6)
    d = rng.normal(size=(20, 3))
    return rng.normal(size=(20, 3)), d / np.linalg.norm(d, axis=1, keepdims=True)


def test_coarse_to_fine_is_that_of_numpy(spark, rays):
    o, d = rays
    field, finer = fields.Field.drawn(3, 1, 16, 4, 2, seed=1), fields.Field.small(2, 1, 16, seed=2)
    rows = [(i, o[i].tolist(), d[i].tolist()) for i in range(len(o))]
    got = {r.ray_id: r for r in fields.render_rays(spark.createDataFrame(rows, "ray_id int, origin array<double>, direction array<double>").repartition(3), field, 1.0, 4.0, 8, 6, finer).collect()}
    z = np.linspace(1, 4, 8)
    for i in range(len(o)):
        rgb, sigma = field(o[i] + z[:, None] * d[i], np.repeat(d[i : i + 1], 8, axis=0))
        c, depth, acc, w = light(z, rgb, sigma)
        assert (rgb >= 0).all() and (rgb <= 1).all() and (sigma >= 0).all()
        r = got[i]
        assert np.allclose([r.r_coarse, r.g_coarse, r.b_coarse, r.depth_coarse, r.acc_coarse], [*c, depth, acc], atol=1e-6)
        more = np.sort(np.concatenate([z, drawn((z[1:] + z[:-1]) / 2, w[1:-1], np.linspace(0, 1, 6))]))
        c, depth, acc, _ = light(more, *finer(o[i] + more[:, None] * d[i], np.repeat(d[i : i + 1], 14, axis=0)))
        assert np.allclose([r.r_fine, r.g_fine, r.b_fine, r.depth_fine, r.acc_fine], [*c, depth, acc], atol=1e-5)


def test_jitter_reruns_and_images(spark):
    eye = np.eye(3).ravel().tolist()
    cams = spark.createDataFrame([(1, eye, [0.0, 0.0, 3.0]), (2, eye, [0.5, 0.0, 3.0])], "img_id int, R array<double>, t array<double>")
    field = fields.Field.small(2, 1, 8, seed=3)
    once, again = ({(r.img_id, r.row, r.col): r for r in fields.render_images(c, 4, 3, 10.0, field, 1.0, 5.0, coarse=6, fine=4, seed=9).collect()} for c in (cams, cams.repartition(3)))
    assert len(once) == 24
    for place, r in once.items():
        assert all(np.isclose(r[c], again[place][c], atol=1e-9) for c in r.asDict()) and all(-1e-9 <= r[c] <= 1 + 1e-4 for c in ("r_fine", "acc_coarse", "acc_fine"))
    only = fields.render_images(cams, 2, 2, 10.0, field, 1.0, 5.0, coarse=6, fine=0)
    assert "r_fine" not in only.columns and only.count() == 8
    z = spark.range(50).select(N.jittered_depths(F.lit(1.0), F.lit(3.0), 9, 4, F.col("id")).alias("z")).collect()
    assert all(r.z == sorted(r.z) and 1 <= r.z[0] and r.z[-1] <= 3 for r in z) and len({tuple(r.z) for r in z}) == 50


def test_sizes_are_checked(spark, monkeypatch):
    monkeypatch.setattr(fields, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="at most 100"):
        fields.evaluate(spark.range(1), fields.Field.small(1, 1, 8))
    assert N.encoded_size(3, 10) == 63 and N.encoded_size(3, 4, False) == 24
    got = spark.range(1).select(N.encode(F.lit(0.3), 3, linear=True).alias("x")).first().x
    assert np.allclose(got, [0.3, *np.ravel([(np.sin(0.3 * f), np.cos(0.3 * f)) for f in (1, 2.5, 4)])])
