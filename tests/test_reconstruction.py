"""Reconstruction of a scene of ten cameras from noisy matches with outliers."""

import numpy as np
import pytest

from prismlake.operators import reconstruction as R
from prismlake.operators.bundle import turned
from prismlake.operators.kernels import align_similarity

K = (800.0, 800.0, 320.0, 240.0)


def scene(cameras, points, seed):
    rng = np.random.default_rng(seed)
    p = rng.uniform(-1.5, 1.5, (points, 3))
    poses = {}
    for i in range(cameras):
        a = np.radians(12 * i)
        r = turned(rng.normal(size=(1, 3)) * 0.05)[0] @ np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]])
        poses[i] = r, np.array([0, 0, 6.0]) + rng.normal(size=3) * 0.1
    return rng, p, poses


def test_ten_cameras(spark):
    rng, p, poses = scene(10, 150, 3)
    features, index = [], {}
    for i, (r, t) in poses.items():
        for f, j in enumerate(rng.permutation(len(p))[:120].tolist()):
            q = r @ p[j] + t
            features.append((i, f, float(800 * q[0] / q[2] + 320 + rng.normal() * 0.3), float(800 * q[1] / q[2] + 240 + rng.normal() * 0.3)))
            index[i, j] = f
    matches = [(i, index[i, j], i + s, index[i + s, j]) for i in range(10) for s in (1, 2, 3) if i + s < 10 for j in range(len(p)) if (i, j) in index and (i + s, j) in index]
    matches += [(8, k, 9, 119 - k) for k in range(3)]  # wrong ones
    features += [(50, f, 10.0 * f, 5.0) for f in range(5)]
    matches += [(9, f, 50, f) for f in range(3)]  # an image with too few
    got = R.reconstruct(spark.createDataFrame(features, "img_id int, feat_id int, u double, v double"), spark.createDataFrame(matches, "img_a int, feat_a int, img_b int, feat_b int"), K)
    cams = {r.img_id: (np.array(r.R).reshape(3, 3), np.array(r.t)) for r in got.cameras.collect()}
    assert set(cams) == set(range(10))
    true = {i: -r.T @ t for i, (r, t) in poses.items()}
    rows = [(*(-cams[i][0].T @ cams[i][1]).tolist(), *true[i].tolist()) for i in cams]
    s = align_similarity(spark.createDataFrame(rows, "x double, y double, z double, a double, b double, c double"), ("x", "y", "z"), ("a", "b", "c")).first()
    turn = np.array(s.R).reshape(3, 3)
    for i, (r, t) in cams.items():
        assert np.linalg.norm(s.scale * turn @ (-r.T @ t) + s.t - true[i]) < 0.05
        away = (r @ turn.T) @ poses[i][0].T
        assert np.degrees(np.arccos(np.clip((np.trace(away) - 1) / 2, -1, 1))) < 1
    cloud = got.cloud().collect()
    assert len(cloud) > 100 and all(x.views >= 2 for x in cloud)


def test_tracks_with_two_features_of_one_image_are_left_out(spark):
    features = spark.createDataFrame([(i, f, float(f), 0.0) for i in range(3) for f in range(4)], "img_id int, feat_id int, u double, v double")
    matches = spark.createDataFrame([(0, 0, 1, 0), (1, 0, 2, 0), (0, 1, 1, 1), (1, 1, 2, 2), (0, 2, 2, 2)], "img_a int, feat_a int, img_b int, feat_b int")
    rows = R.tracks(matches, features).collect()
    assert sorted((r.img_id, r.feat_id) for r in rows) == [(0, 0), (1, 0), (2, 0)] and len({r.track for r in rows}) == 1


def test_nothing_to_begin_with(spark):
    features = spark.createDataFrame([(0, 0, 1.0, 1.0), (1, 0, 1.0, 1.0)], "img_id int, feat_id int, u double, v double")
    with pytest.raises(ValueError, match="no two images"):
        R.reconstruct(features, spark.createDataFrame([(0, 0, 1, 0)], "img_a int, feat_a int, img_b int, feat_b int"), K)
