"""Bundle adjustment on planted problems."""

import numpy as np
import pytest

from prismlake.operators.bundle import bundle_adjust, turned

K = (800.0, 800.0, 320.0, 240.0)


def pixels(r, t, p):
    q = p @ r.T + t
    return np.column_stack([K[0] * q[:, 0] / q[:, 2] + K[2], K[1] * q[:, 1] / q[:, 2] + K[3]])


def frames(spark, cameras, points, seen):
    c = spark.createDataFrame([(i, r.ravel().tolist(), t.tolist()) for i, (r, t) in cameras.items()], "img_id int, R array<double>, t array<double>")
    p = spark.createDataFrame([(i, x.tolist()) for i, x in points.items()], "pt_id long, p array<double>")
    return c, p, spark.createDataFrame(seen, "img_id int, pt_id long, u double, v double")


def error(adjusted, seen):
    cams = {r.img_id: (np.array(r.R).reshape(3, 3), np.array(r.t)) for r in adjusted.cameras.collect()}
    pts = {r.pt_id: np.array(r.p) for r in adjusted.points.collect()}
    return np.array([pixels(*cams[i], pts[j][None])[0] - (u, v) for i, j, u, v in seen if i in cams and j in pts]), cams, pts


def test_two_views_as_planted(spark):
    rng = np.random.default_rng(42)
    a = np.radians(10)
    ry = lambda x: np.array([[np.cos(x), 0, np.sin(x)], [0, 1, 0], [-np.sin(x), 0, np.cos(x)]])
    true = {0: (np.eye(3), np.zeros(3)), 1: (ry(a), np.array([0.5, 0, 0.1]))}
    p = rng.uniform(-1, 1, (30, 3)) + (0, 0, 4)
    seen = [(i, j, *map(float, pixels(r, t, p[j : j + 1])[0] + rng.normal(size=2))) for i, (r, t) in true.items() for j in range(30)]
    start = {0: true[0], 1: (true[1][0] @ ry(np.radians(3)), true[1][1] + (0.05, 0.02, 0.01))}
    got = bundle_adjust(*frames(spark, start, dict(enumerate(p)), seen), K, rounds=20)
    e, cams, pts = error(got, seen)
    assert got.costs[-1] == pytest.approx((e**2).sum()) and sorted(got.costs, reverse=True) == got.costs
    assert got.costs[0] > 10_000 and got.costs[-1] < 60 and len(pts) == 30
    assert (cams[0][0] == np.eye(3)).all() and (cams[0][1] == 0).all()


def test_many_cameras_parts_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr("prismlake.operators.bundle.PART", 60)
    rng = np.random.default_rng(7)
    w = rng.normal(size=(8, 3)) * 0.2
    r, t = turned(w), rng.normal(size=(8, 3)) * 0.3 + (0, 0, 6)
    p = rng.uniform(-1, 1, (50, 3))
    seen = [(3 * i, 10 * j, *map(float, pixels(r[i], t[i], p[j : j + 1])[0])) for i in range(8) for j in range(50) if rng.random() < 0.6]
    noisy = {3 * i: (turned(rng.normal(size=(1, 3)) * 0.02)[0] @ r[i], t[i] + rng.normal(size=3) * 0.03) if i else (r[0], t[0]) for i in range(8)}
    noisy[3] = r[1], t[1]
    points = {10 * j: p[j] + rng.normal(size=3) * 0.05 for j in range(50)}
    odd = [(99, 10, 1.0, 1.0), (3, 777, 1.0, 1.0), (3, 10, None, 1.0)]
    got = bundle_adjust(*frames(spark, noisy, points | {5: np.zeros(3)}, seen + odd), K, held=[0, 3])
    e, cams, pts = error(got, seen)
    assert got.costs[0] > 1e4 and got.costs[-1] < 1e-4 and 5 not in pts and len(cams) == 8
    for i in range(8):
        assert np.allclose(cams[3 * i][0], r[i], atol=1e-5) and np.allclose(cams[3 * i][1], t[i], atol=1e-4)
    none = bundle_adjust(*frames(spark, noisy, points, odd[:1]), K)
    assert none.costs == [0.0] and none.points.count() == 0 and none.cameras.count() == 8


def test_more_cameras_than_the_driver_holds_are_refused(spark, monkeypatch):
    monkeypatch.setattr("prismlake.operators.bundle.MOST_CAMERAS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        bundle_adjust(*frames(spark, {i: (np.eye(3), np.zeros(3)) for i in range(3)}, {1: np.zeros(3)}, [(0, 1, 1.0, 1.0)]), K)
