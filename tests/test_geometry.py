"""Operators against NumPy and against invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions.linear import vec
from prismlake.operators import cameras, clouds, matching, meshes, poses, rendering

rng = np.random.default_rng(7)


def rotation(axis, degrees):
    a, b, c = (np.cos(np.radians(degrees)), np.sin(np.radians(degrees)), 1.0)
    return {"x": [[c, 0, 0], [0, a, -b], [0, b, a]], "y": [[a, 0, b], [0, c, 0], [-b, 0, a]], "z": [[a, -b, 0], [b, a, 0], [0, 0, c]]}[axis]


@pytest.fixture(scope="module")
def pose_rows(spark):
    rows = []
    for k in range(12):
        r = np.array(rotation("x", 11.0 * k)) @ np.array(rotation("y", 31.0 * k)) @ np.array(rotation("z", 180.0 * (k % 2)))
        rows.append((k, r.ravel().tolist(), rng.normal(size=3).tolist(), rng.normal(size=3).tolist()))
    return rows


@pytest.fixture(scope="module")
def pose_table(spark, pose_rows):
    return spark.createDataFrame(pose_rows, "img_id int, R array<double>, t array<double>, p array<double>")


def test_world_camera_round_trip(pose_table, pose_rows):
    q = cameras.world_to_camera(F.col("p"), F.col("R"), F.col("t"))
    d = pose_table.withColumn("q", q)
    got = {r.img_id: r for r in d.withColumn("back", cameras.camera_to_world(F.col("q"), F.col("R"), F.col("t"))).collect()}
    for k, r, t, p in pose_rows:
        assert np.allclose(got[k].q, np.array(r).reshape(3, 3) @ p + t, atol=1e-10)
        assert np.allclose(got[k].back, p, atol=1e-10)


def test_rotations_and_axis_angle(pose_table, pose_rows):
    d = pose_table.withColumn("w", cameras.matrix_axis_angle(F.col("R"))).withColumn("quat", cameras.quaternion(F.col("R")))
    d = d.select("img_id", cameras.axis_angle_matrix(F.col("w")).alias("m"), cameras.quaternion_matrix(F.col("quat")).alias("n"))
    got = {r.img_id: r for r in d.collect()}
    for k, r, _, _ in pose_rows:
        assert np.allclose(got[k].m, r, atol=1e-5)
        assert np.allclose(got[k].n, r, atol=1e-6)


def test_half_turn(spark):
    for axis in "xyz":
        d = spark.range(1).select(cameras.rotation(axis, F.lit(180.0)).alias("R")).withColumn("w", cameras.matrix_axis_angle(F.col("R")))
        w = d.first().w
        assert math.isclose(np.linalg.norm(w), math.pi, abs_tol=1e-6) and abs(w["xyz".index(axis)]) == pytest.approx(math.pi, abs=1e-6)


def test_projection_behind_camera_is_null(spark):
    k = vec(100, 0, 50, 0, 100, 40, 0, 0, 1)
    rows = spark.createDataFrame([([1.0, 2.0, 4.0],), ([1.0, 2.0, -4.0],)], "p array<double>").select(*(c.alias(n) for c, n in zip(cameras.project(F.col("p"), k), "uv", strict=True))).collect()
    assert (rows[0].u, rows[0].v) == (75.0, 90.0) and rows[1].u is None


def test_normalize_points(spark):
    pts = spark.createDataFrame(rng.normal(3, 5, (200, 2)).tolist(), "x double, y double")
    out = np.array([(r.n_x, r.n_y) for r in cameras.normalize_points(pts, "x", "y").collect()])
    assert np.allclose(out.mean(axis=0), 0, atol=1e-9) and np.linalg.norm(out, axis=1).mean() == pytest.approx(math.sqrt(2), rel=1e-6)


def test_homography_maps_plane_points(spark):
    k = np.array([[100, 0, 50], [0, 120, 40], [0, 0, 1.0]])
    r, t, n, depth = np.array(rotation("y", 10)), np.array([0.3, 0.1, 0.2]), np.array([0, 0, 1.0]), 4.0
    c = vec(*k.ravel().tolist())
    h = np.array(spark.range(1).select(cameras.plane_homography(c, c, vec(*r.ravel().tolist()), vec(*t.tolist()), vec(*n.tolist()), F.lit(depth)).alias("h")).first().h).reshape(3, 3)
    assert np.allclose(h, k @ (r - np.outer(t, n) / depth) @ np.linalg.inv(k), atol=1e-9)


def test_neighbours_are_exact_with_far_outliers(spark):
    pts = np.vstack([rng.uniform(0, 10, (150, 3)), rng.uniform(500, 900, (4, 3)), [[5e6, 0, 0]]])
    d = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "pt_id int, x double, y double, z double")
    got = {(r.pt_id, r["rank"]): r.d for r in clouds.neighbours(d, 4, 1.0).collect()}
    full = np.sort(np.linalg.norm(pts[:, None] - pts[None], axis=2), axis=1)
    assert len(got) == 4 * len(pts) and all(got[i, k] == pytest.approx(full[i, k]) for i in range(len(pts)) for k in range(1, 5))


def test_voxels_keep_every_point(spark):
    d = spark.createDataFrame(rng.uniform(-5, 5, (300, 6)).tolist(), "x double, y double, z double, r double, g double, b double")
    v = clouds.voxel_downsample(d, 2.0).collect()
    assert sum(r.n for r in v) == 300 and len({(r.ix, r.iy, r.iz) for r in v}) == len(v) and min(r.ix for r in v) == 0


def test_matching_takes_nearest_and_ratio(spark):
    desc = rng.normal(size=(30, 8)).astype(np.float32)
    d = spark.createDataFrame([(k // 15, k, desc[k].tolist()) for k in range(30)], "img_id int, feat_id int, desc array<float>")
    got = {r.query_idx: r for r in matching.nearest_two(d).collect()}
    assert len(got) == 15
    for q in range(15):
        far = np.linalg.norm(desc[15:].astype(float) - desc[q].astype(float), axis=1)
        assert got[q].train_idx == 15 + far.argmin() and got[q].d1 == pytest.approx(far.min()) and got[q].d2 == pytest.approx(np.sort(far)[1])
    kept = matching.ratio_test(matching.nearest_two(d), 0.9).collect()
    assert {r.query_idx for r in kept} == {q for q, r in got.items() if r.d1 < 0.9 * r.d2}


def test_composite_weights(spark):
    rows = [(r, float(s), float(rng.uniform(0, 3)), 0.5) for r in range(5) for s in range(6)] + [(9, float(s), 0.0, 0.5) for s in range(6)]
    d = spark.createDataFrame(rows, "ray_id int, z double, sigma double, r double")
    out = {x.ray_id: x for x in rendering.composite(d, values=("r",), white=True).collect()}
    assert all(x.acc <= 1 + 1e-4 for x in out.values()) and out[9].r == pytest.approx(1, abs=1e-5)
    sig = np.array([x[2] for x in rows if x[0] == 0])
    alpha = 1 - np.exp(-sig * np.array([1] * 5 + [1e10]))
    w = alpha * np.cumprod(np.concatenate([[1], (1 - alpha + 1e-10)[:-1]]))
    assert out[0].acc == pytest.approx(w.sum()) and out[0].depth == pytest.approx((w * np.arange(6)).sum())


def test_inverse_cdf_ends(spark):
    d = spark.range(1).select(*(rendering.inverse_cdf(vec(1, 2, 4), vec(1, 3), F.lit(u)).alias(n) for u, n in ((0.0, "a"), (0.25, "b"), (1.0, "c")))).first()
    assert d.a == pytest.approx(1) and d.b == pytest.approx(2, abs=1e-4) and d.c == pytest.approx(4)


def test_closed_mesh(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "vid int, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 2, 1), (1, 0, 1, 3), (2, 0, 3, 2), (3, 1, 2, 3)], "fid int, a int, b int, c int")
    q = meshes.quality(f, v).first()
    assert q.watertight and q.euler == 2 and q.n_edges == 6 and q.volume == pytest.approx(1 / 6)
    twice = f.unionByName(f.withColumn("fid", F.col("fid") + 10)).unionByName(spark.createDataFrame([(99, 0, 0, 1)], f.schema))
    assert {r.fid for r in meshes.clean(twice, v).collect()} == {0, 1, 2, 3}


def test_pose_graph(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (2, 3), (3, 4)], "src int, dst int")
    got = {r.img_id: r.links for r in poses.next_images(e, spark.createDataFrame([(1,), (2,)], "img_id int")).collect()}
    assert got == {3: 3}
