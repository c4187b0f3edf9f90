"""Comparisons and small camera and mesh operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import cameras, compare, meshes


def test_images_of_bytes_and_of_shares(spark):
    rng = np.random.default_rng(2)
    true, made = rng.integers(0, 256, (2, 3, 4, 3)), rng.random((2, 3, 4, 3))
    rows = lambda x: [(i, r, c, *map(float, x[i, r, c])) for i in range(2) for r in range(3) for c in range(4)]
    a, b = (spark.createDataFrame(rows(x), "img_id int, row int, col int, r double, g double, b double") for x in (true, made))
    errors = {(r.img_id, r.row, r.col): (r.error, r.share) for r in compare.image_errors(a, b).collect()}
    for i in range(2):
        e = np.sqrt(((true[i] / 255 - made[i]) ** 2).sum(axis=2))
        for r in range(3):
            for c in range(4):
                assert errors[i, r, c] == pytest.approx((e[r, c], e[r, c] / (e.max() + 1e-8)))
    m = {r.img_id: r for r in compare.image_metrics(compare.image_errors(a, b)).collect()}
    assert m[0].psnr == pytest.approx(-10 * np.log10(((true[0] / 255 - made[0]) ** 2).mean()))
    assert compare.image_metrics(compare.image_errors(a, a)).first().psnr == float("inf")


def test_depths_clouds_and_winding(spark):
    d = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 0.0), (1, None), (2, 5.0)], "img_id int, d double")
    assert sorted(tuple(r) for r in compare.depth_ranges(d).collect()) == [(1, 2, 2.0, 4.0, 3.0), (2, 1, 5.0, 5.0, 5.0)]
    assert sorted(round(r.share, 6) for r in compare.depth_shares(d).collect() if r.share is not None) == [0.0, 0.0, 1.0]
    rng = np.random.default_rng(4)
    p, q = rng.normal(size=(200, 3)), rng.normal(size=(20, 3)) * 3
    cloud = lambda x: spark.createDataFrame([(k, *v) for k, v in enumerate(x.tolist())], "pt_id long, x double, y double, z double")
    far = np.linalg.norm(q[:, None] - p[None], axis=2).min(axis=1)
    one = compare.cloud_comparison(cloud(q), cloud(p)).first()
    assert (one.sparse_n, one.dense_n) == (20, 200) and (one.mean_distance, one.max_distance) == pytest.approx((far.mean(), far.max()))
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3)], "fid int, a int, b int, c int")
    assert meshes.winding_consistent(faces).first().consistent and meshes.winding_consistent(faces.limit(0)).first().consistent
    assert not meshes.winding_consistent(faces.withColumns({"b": F.col("c"), "c": F.col("b")}).where("fid = 1").unionByName(faces.where("fid = 0"))).first().consistent


def test_normalisation_matrices(spark):
    x = np.random.default_rng(1).normal(size=(30, 2)) * 7 + 3
    d = spark.createDataFrame(x.tolist(), "u double, v double")
    t = np.array(cameras.normalizations(d, "u", "v").first()["T"]).reshape(3, 3)
    y = (np.column_stack([x, np.ones(30)]) @ t.T)[:, :2]
    assert np.allclose(y.mean(axis=0), 0) and np.linalg.norm(y, axis=1).mean() == pytest.approx(np.sqrt(2))
    own = sorted((r.n_u, r.n_v) for r in cameras.normalize_points(d, "u", "v").collect())
    assert np.allclose(own, sorted(map(tuple, y)))
