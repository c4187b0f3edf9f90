"""Two-view geometry on a synthetic scene, at the reference tolerances."""

import numpy as np

from prismlake.operators import matching, two_view

K = np.array([[800.0, 0, 320], [0, 800, 240], [0, 0, 1]])


def scene(noise=0.5, outliers=20, n=100):
    gen = np.random.default_rng(123)
    x = np.column_stack([gen.uniform(-2, 2, n), gen.uniform(-2, 2, n), gen.uniform(2, 8, n)])
    a = np.radians(10)
    r, t = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]]), np.array([0.5, 0, 0.1])
    x1, x2 = (q[:, :2] / q[:, 2:] for q in (x @ K.T, (x @ r.T + t) @ K.T))
    x1, x2 = x1 + gen.normal(0, noise, x1.shape), x2 + gen.normal(0, noise, x2.shape)
    x2[:outliers] = gen.uniform(0, 600, (outliers, 2))
    return x, r, t, x1, x2


def test_pose_is_recovered(spark):
    x, r, t, x1, x2 = scene()
    d = spark.createDataFrame([(1, 2, *map(float, (*a, *b))) for a, b in zip(x1, x2, strict=True)] + [(3, 4, 1.0, 1.0, 2.0, 2.0)] * 5, "img_a int, img_b int, u1 double, v1 double, u2 double, v2 double")
    got = {(p.img_a, p.img_b): p for p in two_view.relative_poses(d, K.ravel()).collect()}
    assert got[3, 4].R is None
    own = np.array(got[1, 2].R).reshape(3, 3)
    assert np.degrees(np.arccos(np.clip((np.trace(own @ r.T) - 1) / 2, -1, 1))) < 3 and np.dot(got[1, 2].t, t / np.linalg.norm(t)) > 0.98
    assert got[1, 2].mean_error < 1.5 and got[1, 2].n_inliers >= 60
    f = {p.img_a: p for p in two_view.fundamental_matrices(d).collect()}
    assert f[1].mean_error < 1 and abs(np.linalg.det(np.array(f[1].F).reshape(3, 3))) < 1e-12 and f[3].F is None
    seen = two_view.verified_matches(d)
    wrong = {tuple(map(float, (*a, *b))) for a, b in zip(x1[:20], x2[:20], strict=True)}
    kept = [p for p in seen.where("img_a = 1").collect() if p.inlier]
    assert sum((p.u1, p.v1, p.u2, p.v2) in wrong for p in kept) <= 3 and len(kept) >= 75
    summary = {p.img_a: p for p in matching.match_summary(seen).collect()}
    assert summary[1].num_matches == 100 and summary[1].inlier_ratio > 0.3 and summary[3].num_inliers == 0
    assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, two_view.verified_matches(d.repartition(3)).collect()))


def test_clean_points_come_back():
    x, r, t, x1, x2 = scene(noise=0, outliers=0)
    f, inside = two_view.fundamental(x1, x2)
    own, to, points = two_view.decompose(two_view.essential(f, K), K, x1, x2)
    assert inside.all() and np.allclose(own, r, atol=1e-6) and np.allclose(to, t / np.linalg.norm(t), atol=1e-6)
    assert np.allclose(points * np.linalg.norm(t), x, atol=1e-4)
