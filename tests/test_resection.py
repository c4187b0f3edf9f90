"""Poses from points with planted outliers."""

import numpy as np
import pytest

from prismlake.operators import resection
from prismlake.operators.bundle import turned

K = (800.0, 800.0, 320.0, 240.0)


def scene(n, seed, noise=0.0, wrong=0.0):
    rng = np.random.default_rng(seed)
    r, t, p = turned(rng.normal(size=(1, 3)) * 0.4)[0], rng.normal(size=3) * 0.4 + (0, 0, 6), rng.uniform(-1.5, 1.5, (n, 3))
    q = p @ r.T + t
    uv = np.column_stack([800 * q[:, 0] / q[:, 2] + 320, 800 * q[:, 1] / q[:, 2] + 240]) + rng.normal(size=(n, 2)) * noise
    bad = rng.random(n) < wrong
    uv[bad] += rng.uniform(40, 300, (bad.sum(), 2))
    return r, t, p, uv, bad


@pytest.mark.parametrize("seed", range(20))
def test_three_points_give_the_pose(seed):
    r, t, p, uv, _ = scene(3, seed)
    found = resection.from_three(p, resection.bearings(uv, K))
    assert found and min(np.abs(a - r).max() + np.abs(b - t).max() for a, b in found) < 1e-5


def test_poses_of_many_images(spark):
    scenes, rows = {}, []
    for img, (n, noise, wrong) in enumerate([(60, 0.0, 0.0), (80, 0.5, 0.3), (200, 0.5, 0.5), (4, 0.0, 0.0), (3, 0.0, 0.0), (12, 0.0, 0.2)]):
        scenes[img] = scene(n, img + 50, noise, wrong)
        rows += [(img, p.tolist(), float(u), float(v)) for p, (u, v) in zip(scenes[img][2], scenes[img][3], strict=True)]
    rows += [(0, None, 1.0, 1.0), (0, [0.0, 0.0, 0.0], None, 1.0)]
    d = spark.createDataFrame(rows, "img_id int, p array<double>, u double, v double").repartition(4)
    got = {r.img_id: r for r in resection.poses_from_points(d, K).collect()}
    assert got[4].R is None and got[4].error is None and got[4].n == 3 and set(got) == set(scenes)
    for img in (0, 1, 2, 3, 5):
        r, t, p, _, bad = scenes[img]
        a = np.array(got[img].R).reshape(3, 3)
        angle = np.degrees(np.arccos(np.clip((np.trace(a @ r.T) - 1) / 2, -1, 1)))
        assert angle < 0.3 and np.linalg.norm(np.array(got[img].t) - t) < 0.05 and got[img].error < 3
        assert got[img].n == len(p) and abs(got[img].n_inliers - (~bad).sum()) <= 2
    again = {r.img_id: r for r in resection.poses_from_points(d.repartition(7), K).collect()}
    assert again[2] == got[2]


def test_refinement_and_the_best_of_several(spark):
    r, t, p, uv, _ = scene(40, 9, 0.3)
    d = spark.createDataFrame([(7, x.tolist(), float(u), float(v)) for x, (u, v) in zip(p, uv, strict=True)], "img_id int, p array<double>, u double, v double")
    off = turned(np.array([[0.03, -0.02, 0.04]]))[0] @ r
    start = spark.createDataFrame([(7, off.ravel().tolist(), (t + 0.05).tolist()), (8, np.eye(3).ravel().tolist(), [0.0, 0.0, 1.0])], "img_id int, R array<double>, t array<double>")
    before = resection.errors(off, t + 0.05, p, uv, K).mean()
    got = {x.img_id: x for x in resection.refined_poses(d, start, K).collect()}
    assert before > 10 and got[7].error < 0.6 and got[8].error is None and got[8].R == np.eye(3).ravel().tolist()
    one = resection.poses_from_points(d, K, start=start)
    best = {x.img_id: x for x in resection.best_poses(one, resection.refined_poses(d, start, K)).collect()}
    assert best[7].error == min(got[7].error, one.first().error) and best[8].error is None
    assert resection.poses_from_points(d.limit(0), K).count() == 0
