"""Parts of a bundle adjustment: whole points together, and products that equal those of the matrices."""

import numpy as np
import pyarrow as pa

from prismlake.operators import bundle as B

K = (800.0, 700.0, 320.0, 240.0)


def rows(seed, cameras, points, first=0):
    rng = np.random.default_rng(seed)
    r, t = B.turned(rng.normal(size=(cameras, 3)) * 0.3), rng.normal(size=(cameras, 3)) * 0.2 + (0, 0, 5)
    t[0] = 0, 0, -9  # sees nothing ahead
    p = rng.uniform(-1, 1, (points, 3))
    seen = [(i, first + j) for j in range(points) for i in range(cameras) if rng.random() < 0.7]
    uv = rng.uniform(0, 500, (len(seen), 2))
    table = pa.table({"cam": pa.array([i for i, _ in seen], pa.int32()), "pt_id": pa.array([j for _, j in seen], pa.int64()), "p": pa.array([p[j - first].tolist() for _, j in seen], B.LISTS), "u": uv[:, 0], "v": uv[:, 1]})
    return (r, t), p, table


def test_parts_are_whole_points():
    _, _, t = rows(1, 5, 40)
    parts = list(B._packed(30)(iter(t.to_batches(max_chunksize=7))))
    ids = [np.frombuffer(x.column("ids")[0].as_py(), np.int64).tolist() for x in parts]
    assert sorted(i for x in ids for i in x) == sorted(set(t.column("pt_id").to_pylist())) and len(parts) > 3
    sizes = [len(x.column("cams")[0].as_py()) // 4 for x in parts]
    assert sum(sizes) == len(t) and max(sizes) <= 35 and list(B._packed(30)(iter([]))) == []


def test_parts_have_the_cameras_of_their_scene(spark, monkeypatch):
    """Two scenes whose points alternate: no part holds cameras of both, so sums by camera stay small."""
    monkeypatch.setattr(B, "PART", 40)
    made = []
    monkeypatch.setattr(B, "_Problem", lambda parts, k: made.append(parts.select("own").collect()) or 1 / 0)
    cams = spark.createDataFrame([(i, np.eye(3).ravel().tolist(), [0.0, 0.0, 5.0]) for i in range(12)], "img_id long, R array<double>, t array<double>")
    pts = spark.createDataFrame([(j, [0.0, 0.0, 0.0]) for j in range(200)], "pt_id long, p array<double>")
    seen = spark.createDataFrame([(j % 2 * 6 + i, j, 1.0, 1.0) for j in range(200) for i in range(6)], "img_id long, pt_id long, u double, v double")
    try:
        B.bundle_adjust(cams, pts, seen, K)
    except ZeroDivisionError:
        pass
    own = [set(np.frombuffer(r.own, np.int32).tolist()) for r in made[0]]
    assert len(own) > 10 and sum(min(x) < 6 <= max(x) for x in own) <= 1


def test_products_equal_those_of_the_matrices():
    (r, t), p, table = rows(2, 4, 6)
    part = B._Part(B._pack(table).to_pylist()[0], (r, t), K)
    cam, pt = np.array(table.column("cam")), np.array(table.column("pt_id"))
    order = np.lexsort((cam, pt))
    cam, pt, uv = cam[order], pt[order], np.column_stack([np.array(table.column(c)) for c in "uv"])[order]

    def residuals(x):
        turn, shift, at = B.turned(x[:12].reshape(4, 3)) @ r, t + x[12:24].reshape(4, 3), p + x[24:].reshape(6, 3)
        q = np.einsum("nij,nj->ni", turn[cam], at[pt]) + shift[cam]
        e = np.column_stack([K[0] * q[:, 0] / q[:, 2] + K[2], K[1] * q[:, 1] / q[:, 2] + K[3]]) - uv
        return (e * (q[:, 2:] > 0)).ravel()

    # a turn about the camera's own axes leaves the shift alone
    j = np.stack([(residuals(h) - residuals(-h)) / 2e-6 for h in np.eye(42) * 1e-6], axis=1)
    e = residuals(np.zeros(42))
    jc = np.concatenate([j[:, :12].reshape(-1, 4, 3), j[:, 12:24].reshape(-1, 4, 3)], axis=2).reshape(-1, 24)
    jx, damping = j[:, 24:], 0.1
    v = jx.T @ jx
    v = v + np.diag(damping * np.diag(v))
    w, x = jc.T @ jx, np.random.default_rng(3).normal(size=(4, 6))
    part.eliminate(damping)
    near = lambda a, b: np.allclose(a, b, rtol=1e-5, atol=1e-5 * np.abs(b).max())
    assert near(part.product(x).ravel(), w @ np.linalg.solve(v, w.T @ x.ravel()))
    assert near(part.step(x).ravel(), np.linalg.solve(v, -jx.T @ e - w.T @ x.ravel()))
    sums = part.normal()
    own, taken = jc.T @ jc, w @ np.linalg.solve(v, w.T)
    block = lambda m: np.stack([m[a : a + 6, a : a + 6] for a in range(0, 24, 6)])
    assert near(B._whole(sums[:, :21]), block(own)) and near(B._whole(sums[:, 27:]), block(taken))
    assert near(sums[:, 21:27].ravel(), -jc.T @ e - w @ np.linalg.solve(v, -jx.T @ e))
