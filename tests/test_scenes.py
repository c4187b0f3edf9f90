"""Paths, depth and scene operators against NumPy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import clouds, depth, kernels, matching, meshes, paths, scenes
from prismlake.operators import rendering as N


def poses(n, seed=3):
    gen, out = np.random.default_rng(seed), []
    for k in range(n):
        q, _ = np.linalg.qr(np.eye(3) + 0.2 * gen.standard_normal((3, 3)))
        q *= np.sign(np.linalg.det(q))
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = q, gen.uniform(-2, 2, 3)
        out.append((k, m.ravel().tolist()))
    return out


def test_spiral_is_that_of_numpy(spark):
    rows = poses(9)
    d = spark.createDataFrame(rows, "img_id int, c2w array<double>")
    f = spark.range(12).select(F.col("id").alias("i"), (F.col("id") / 12).alias("t"))
    got = {r.i: np.array(r.c2w).reshape(4, 4) for r in paths.spiral(f, F.col("t"), d).collect()}
    m = np.array([r[1] for r in rows]).reshape(-1, 4, 4)
    centre = m[:, :3, 3].mean(axis=0)
    radius = np.percentile(np.linalg.norm(m[:, :3, 3] - centre, axis=1), 75) * 0.75
    u, _, vt = np.linalg.svd(m[:, :3, :3].mean(axis=0))
    for i in range(12):
        a = i / 12 * 4 * np.pi
        at = centre + u @ vt @ np.array([radius * np.cos(a), radius * np.sin(a), radius * 0.25 * np.sin(i / 12 * 2 * np.pi)])
        assert np.allclose(got[i][:3, 3], at) and np.allclose(got[i][:3, :3].T @ got[i][:3, :3], np.eye(3), atol=1e-6)
        assert np.allclose(got[i][:3, 2], -(centre - at) / np.linalg.norm(centre - at), atol=1e-6)


def test_normals_of_a_plane_and_of_numpy(spark):
    gen = np.random.default_rng(1)
    rows = [(k, float(x), float(y), float(0.3 * x - 0.2 * y)) for k, (x, y) in enumerate(gen.uniform(-1, 1, (200, 2)))]
    p = spark.createDataFrame(rows, "pt_id long, x double, y double, z double")
    near = clouds.neighbours(p, 10)
    n = np.array([r.n for r in scenes.normals(p, near, (0.0, 0.0, 9.0)).collect()])
    want = np.array([-0.3, 0.2, 1]) / np.linalg.norm([-0.3, 0.2, 1])
    assert np.allclose(n, want, atol=1e-6)


@pytest.mark.parametrize("spread", [1.0, 1000.0])
def test_neighbours_are_those_of_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(clouds, "PART_POINTS", 40)
    gen = np.random.default_rng(2)
    x = np.concatenate([gen.normal(0, 1, (120, 3)), gen.normal(0, 1, (5, 3)) * spread * 100, np.zeros((6, 3)), np.ones((3, 3))])
    p = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "pt_id long, x double, y double, z double")
    got = {(r.pt_id, r["rank"]): (r.nn_id, r.d) for r in clouds.neighbours(p, 7).collect()}
    assert len(got) == 7 * len(x)
    for i, a in enumerate(x):
        d = np.sqrt(((x[:, 0] - a[0]) ** 2 + (x[:, 1] - a[1]) ** 2) + (x[:, 2] - a[2]) ** 2)
        order = sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[j], j))[:7]
        assert [got[i, k + 1][0] for k in range(7)] == order and np.allclose([got[i, k + 1][1] for k in range(7)], d[order])
    assert clouds.neighbours(p.limit(1), 7).count() == 0 and clouds.neighbours(p.where("pt_id < 3"), 7).count() == 6


def test_quantiles(spark):
    gen = np.random.default_rng(5)
    v = np.concatenate([gen.normal(0, 1, 301), np.zeros(50), [1e9, -1e9]])
    d = spark.createDataFrame([(float(x), float(x) * 2) for x in v] + [(None, None)], "a double, b double")
    for share in (0.0, 0.1, 0.5, 0.9, 0.999, 1.0):
        got = clouds.quantiles(d, ("a", "b"), share).first()
        assert np.allclose([got.a, got.b], [np.quantile(v, share), np.quantile(2 * v, share)])


def test_matches_over_blocks_are_those_of_one(spark):
    gen = np.random.default_rng(6)
    x = gen.integers(0, 3, (90, 4)).astype(float)
    f = spark.createDataFrame([(k % 3, k, x[k].tolist()) for k in range(90)], "img_id int, feat_id long, desc array<double>")
    want = {}
    for a in range(90):
        for img in range(a % 3 + 1, 3):
            order = sorted((float(((x[a] - x[b]) ** 2).sum()), b) for b in range(90) if b % 3 == img)
            want[a, img] = (order[0][1], np.sqrt(order[0][0]), np.sqrt(order[1][0]))
    for block in (2000, 7):
        got = {(r.query_idx, r.img_b): (r.train_idx, r.d1, r.d2) for r in matching.nearest_two(f, block=block).collect()}
        assert got == want


def test_view_cost_and_correlation(spark):
    d = spark.createDataFrame([(1, [0.5, -0.2, 0.9]), (2, [0.5, 0.1]), (3, []), (4, [0.3]), (5, [None, 0.2])], "i int, s array<double>")
    got = {r.i: r.c for r in d.select("i", depth.view_cost(F.col("s")).alias("c")).collect()}
    assert got == pytest.approx({1: 0.7, 2: 0.3, 3: -1.0, 4: 0.3, 5: 0.2})
    gen = np.random.default_rng(7)
    a, b = gen.random(49), gen.random(49)
    rows = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(a, b, strict=True)] + [(2, 1.0, 1.0)] * 4, "p int, a double, b double")
    ncc = {r.p: r.ncc for r in depth.correlation(rows, "p").collect()}
    assert ncc[1] == pytest.approx(np.mean((a - a.mean()) * (b - b.mean())) / ((a.std() + 1e-8) * (b.std() + 1e-8))) and ncc[2] == pytest.approx(0)


def test_pose_graph(spark):
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    nodes = spark.createDataFrame([(1, one, [0.0, 0.0, 0.0]), (2, one, [3.0, 4.0, 0.0])], "img_id long, R array<double>, t array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 9)], "i long, j long")
    assert {(r.i, r.j): r.baseline for r in scenes.baselines(pairs, nodes).collect()} == {(1, 2): 5.0, (1, 9): 0.0}
    assert {r.img_id: r.present for r in scenes.has_node(spark.range(1, 4).toDF("img_id"), nodes).collect()} == {1: True, 2: True, 3: False}
    assert {r.img_id: r.t for r in scenes.get_poses(spark.range(1, 4).toDF("img_id"), nodes).collect()} == {1: [0, 0, 0], 2: [3, 4, 0], 3: None}
    fresh = spark.createDataFrame([(2, one, [9.0, 9.0, 9.0]), (7, one, [1.0, 1.0, 1.0])], "img_id long, R array<double>, t array<double>")
    assert {r.img_id: r.t for r in scenes.update_poses(nodes, fresh).collect()} == {1: [0, 0, 0], 2: [9, 9, 9]}
    edges = spark.createDataFrame([(1, 3), (1, 4), (2, 4), (4, 2)], "src long, dst long")
    best = scenes.best_next(edges, nodes).collect()
    assert [(r.img_id, r.links) for r in best] == [(4, 3)] and scenes.best_next(edges, nodes.limit(0)).count() == 0
    assert sorted(map(tuple, scenes.from_json(scenes.to_json(nodes)).collect())) == sorted(map(tuple, nodes.collect()))
    assert json.loads(scenes.to_json(nodes).orderBy("value").first().value)["img_id"] == 1
    assert scenes.scene_scale(nodes).first().scale == 5.0 and scenes.scene_scale(nodes.limit(1)).first().scale == 1.0


def test_good_points_and_shade(spark):
    d = spark.range(1).select(N.shade(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).alias("a"), N.shade(F.array(F.lit(0.0), F.lit(-1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))).alias("b")).first()
    assert d.a == 1.0 and d.b == 0.25
    assert callable(kernels.good_points) and callable(meshes.clean)


def test_projections_of_either_sign_have_rotations(spark):
    k = np.array([[700.0, 2, 300], [0, 650, 200], [0, 0, 1]])
    r = np.linalg.qr(np.random.default_rng(2).normal(size=(3, 3)))[0]
    r *= np.linalg.det(r)
    p = k @ np.column_stack([r, [0.3, -0.2, 5.0]])
    rows = [(s, (p * s).ravel().tolist()) for s in (-3.0, -0.01, 1.0, 40.0)]
    for x in scenes.decompose_projection(spark.createDataFrame(rows, "s double, P array<double>")).collect():
        assert np.allclose(np.array(x.K).reshape(3, 3), k) and np.allclose(np.array(x.R).reshape(3, 3), r) and np.allclose(x.t, [0.3, -0.2, 5.0])
