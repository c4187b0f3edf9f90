"""Orientation of normals and surfaces from signed distances, against NumPy."""

import itertools

import numpy as np
import pandas as pd
import pytest

from prismlake.operators import clouds, meshes, surfaces


def kruskal(normals, edges):
    """Signs along the minimum spanning forest, by sorted edges."""
    tree = {i: i for i in normals}
    turn = dict.fromkeys(normals, 1)
    order = sorted((1 - abs(float(normals[a] @ normals[b])), a, b) for a, b in edges)
    for _, a, b in order:
        if tree[a] != tree[b]:
            flip = (-1 if normals[a] @ normals[b] < 0 else 1) * turn[a] * turn[b]
            old, new = tree[b], tree[a]
            for i in tree:
                if tree[i] == old:
                    tree[i], turn[i] = new, turn[i] * flip
    first = {}
    for i in sorted(tree):
        first.setdefault(tree[i], turn[i])
    return {i: normals[i] * turn[i] * first[tree[i]] for i in normals}


def frame(spark, p, n):
    return spark.createDataFrame([(i, *x.tolist(), m.tolist()) for i, (x, m) in enumerate(zip(p, n, strict=True))], "pt_id long, x double, y double, z double, n array<double>")


def test_orientation_is_that_of_the_spanning_forest(spark):
    rng = np.random.default_rng(8)
    n = rng.normal(size=(120, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    edges = {tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(150)} | {tuple(sorted(map(int, rng.choice(range(60, 110), 2, replace=False)))) for _ in range(90)}
    d = frame(spark, rng.normal(size=(120, 3)), n)
    near = spark.createDataFrame([*edges, *((b, a) for a, b in edges), (3, 3)], "pt_id long, nn_id long")
    got = {r.pt_id: np.array(r.n) for r in surfaces.orient_normals(d.select("pt_id", "n"), near).collect()}
    want = kruskal(dict(enumerate(n)), edges)
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-6) for i in want)


def ball(n, seed):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def test_normals_of_a_ball_agree(spark):
    p = ball(300, 2)
    n = p * np.where(np.random.default_rng(1).random(300) < 0.5, -1, 1)[:, None]
    d = frame(spark, p, n)
    got = {r.pt_id: np.array(r.n) for r in surfaces.orient_normals(d.select("pt_id", "n"), clouds.neighbours(d, 10)).collect()}
    sides = {np.sign(got[i] @ p[i]) for i in got}
    assert len(sides) == 1 and len(got) == 300


def test_distances_blur_and_surface(spark):
    p = ball(400, 5)
    d = frame(spark, p, p)
    cells = 14
    got = surfaces.signed_distances(d, cells, 10).toPandas().set_index(["ix", "iy", "iz"]).tsdf
    lo, hi = p.min(axis=0) - 0.1, p.max(axis=0) + 0.1
    axes = [np.linspace(lo[j], hi[j], cells) for j in range(3)]
    want = np.zeros((cells,) * 3)
    for i, j, k in itertools.product(range(cells), repeat=3):
        g = np.array([axes[0][i], axes[1][j], axes[2][k]])
        far = np.linalg.norm(p - g, axis=1)
        at = np.argsort(far, kind="stable")[:10]
        w = np.exp(-far[at] ** 2 / (2 * ((hi - lo)[0] / cells) ** 2))
        want[i, j, k] = (w * ((g - p[at]) * p[at]).sum(axis=1)).sum() / (w.sum() + 1e-8)
    assert len(got) == cells**3 and np.allclose([got[x] for x in itertools.product(range(cells), repeat=3)], want.ravel(), atol=1e-9)
    kernel = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    soft = want
    for axis in range(3):
        soft = np.apply_along_axis(lambda x: np.convolve(np.pad(x, 4, mode="symmetric"), kernel / kernel.sum(), mode="valid"), axis, soft)
    grid = spark.createDataFrame(pd.DataFrame([(*x, want[x]) for x in itertools.product(range(cells), repeat=3)], columns=["ix", "iy", "iz", "tsdf"]))
    blur = surfaces.blurred(grid, cells).toPandas().set_index(["ix", "iy", "iz"]).tsdf
    assert np.allclose([blur[x] for x in itertools.product(range(cells), repeat=3)], soft.ravel(), atol=1e-9)
    faces, vertices = surfaces.surface(d, 24)
    q = meshes.quality(faces, vertices).first()
    r = np.linalg.norm(np.array([(v.x, v.y, v.z) for v in vertices.collect()]), axis=1)
    assert q.n_faces > 500 and q.watertight and q.euler == 2 and q.volume == pytest.approx(4 / 3 * np.pi, rel=0.15) and abs(np.median(r) - 1) < 0.1
