"""Images that share so few points with others that none can be placed by them: relative poses lay these."""

import numpy as np

from prismlake.operators import reconstruction as R
from prismlake.operators.bundle import turned
from prismlake.operators.kernels import align_similarity

K = (800.0, 800.0, 320.0, 240.0)


def test_images_with_points_of_pairs_alone(spark):
    """Each point is seen by two images: no third one can be placed by points."""
    rng = np.random.default_rng(5)
    poses = {i: (turned(np.array([[0.05 * (i % 3), 0.4 * i, 0.0]]))[0], np.array([0.1 * (i % 4), 0.0, 8.0])) for i in range(9)}
    features, matches = [], []
    for i in range(9):
        for j in range(i + 1, min(i + 4, 9)):
            for p in rng.uniform(-2, 2, (14, 3)):
                f = len(features)
                for n in (i, j):
                    q = poses[n][0] @ p + poses[n][1]
                    features.append((n, f, float(800 * q[0] / q[2] + 320), float(800 * q[1] / q[2] + 240)))
                matches.append((i, f, j, f))
    got = R.reconstruct(spark.createDataFrame(features, "img_id int, feat_id int, u double, v double"), spark.createDataFrame(matches, "img_a int, feat_a int, img_b int, feat_b int"), K)
    cams = {r.img_id: -np.array(r.R).reshape(3, 3).T @ np.array(r.t) for r in got.cameras.collect()}
    assert set(cams) == set(range(9)) and got.points.count() == len(matches)
    true = {i: -r.T @ t for i, (r, t) in poses.items()}
    s = align_similarity(spark.createDataFrame([(*cams[i].tolist(), *true[i].tolist()) for i in cams], "x double, y double, z double, a double, b double, c double"), ("x", "y", "z"), ("a", "b", "c")).first()
    for i, c in cams.items():
        assert np.linalg.norm(s.scale * np.array(s.R).reshape(3, 3) @ c + s.t - true[i]) < 1e-5


def test_images_are_laid_by_poses_that_agree():
    rng = np.random.default_rng(6)
    r, c = turned(rng.normal(size=(6, 3)) * 0.4), rng.uniform(-3, 3, (6, 3))
    t = -np.einsum("nij,nj->ni", r, c)
    pose = lambda a, b: (a, b, r[b] @ r[a].T, (t[b] - r[b] @ r[a].T @ t[a]) * rng.uniform(0.5, 2))
    pairs = [pose(0, 2), pose(1, 2), pose(2, 3), pose(3, 0), pose(3, 4), pose(1, 5)]
    pairs.append((1, 3, turned(np.array([[0.0, 2.0, 1.0]]))[0], np.array([1.0, 0.0, 0.0])))  # a wrong one
    found = R.laid(pairs, {0: (r[0], t[0]), 1: (r[1], t[1])})
    assert list(found) == [2, 3]  # 4 and 5 have one way each
    assert all(np.allclose(found[i][0], r[i]) and np.allclose(found[i][1], t[i]) for i in found)
