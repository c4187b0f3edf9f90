"""Images, camera files, meshes and job status on disk."""

import json
import struct
import zlib

import numpy as np
import pytest

from prismlake.operators.cameras import center
from prismlake.sources import meshes, scenes
from prismlake.sources.ply import read_ply


def png(path, x):
    """A PNG file of h x w x 3 bytes."""
    h, w = x.shape[:2]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in x)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def images(tmp_path):
    rng, out = np.random.default_rng(1), {}
    (tmp_path / "images").mkdir()
    for name in ("a.png", "b.png"):
        out[name] = rng.integers(0, 256, (3, 4, 3), np.uint8)
        png(tmp_path / "images" / name, out[name])
    (tmp_path / "images" / "0notes.txt").write_text("no image")
    return out


def test_images_and_their_pixels(spark, tmp_path, images):
    d = scenes.read_images(spark, str(tmp_path / "images"))
    assert sorted((r.name, r.width, r.height) for r in d.collect()) == [("a.png", 4, 3), ("b.png", 4, 3)]
    rows = scenes.image_pixels(d).collect()
    assert len(rows) == 24 and all((r.r, r.g, r.b) == tuple(images[r.name][r.row, r.col]) for r in rows)
    assert scenes.image_size(spark, str(tmp_path / "images")) == (4, 3)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    assert scenes.image_size(spark, str(tmp_path / "none")) == (640, 480)


def test_camera_files_and_datasets(spark, tmp_path, images):
    eye = np.eye(3)
    poses = {"0": {"R": eye.tolist(), "t": [[0.0], [0.0], [0.0]], "image": "a.png"}, "7": {"R": eye.tolist(), "t": [[0.5], [0.0], [2.0]], "image": "b.png"}}
    (tmp_path / "cameras.json").write_text(json.dumps({"K": [[5, 0, 2], [0, 6, 1.5], [0, 0, 1]], "poses": poses}, indent=2))
    cams = scenes.read_camera_file(spark, str(tmp_path / "cameras.json"))
    rows = {r.img_id: r for r in cams.collect()}
    assert set(rows) == {0, 7} and rows[7].t == [0.5, 0.0, 2.0] and rows[7].name == "b.png" and rows[0].K[4] == 6
    d = scenes.dataset_rays(cams, scenes.read_images(spark, str(tmp_path / "images"))).collect()
    assert len(d) == 24
    for r in d:
        q = np.array([(r.col - 2) / 5, (r.row - 1.5) / 6, 1])
        assert np.allclose(r.direction, q / np.linalg.norm(q), atol=1e-6) and np.allclose((r.r, r.g, r.b), images["a.png" if r.img_id == 0 else "b.png"][r.row, r.col] / 255)
        assert np.allclose(r.origin, [0, 0, 0] if r.img_id == 0 else [-0.5, 0, -2])
    m = np.diag([1.0, -1, -1, 1])
    m[:3, 3] = 1, 2, 3
    (tmp_path / "transforms.json").write_text(json.dumps({"camera_angle_x": 0.8, "frames": [{"file_path": "./images/b", "transform_matrix": m.tolist()}]}))
    t = scenes.read_transforms(spark, str(tmp_path / "transforms.json"))
    one = t.select("name", "angle", "R", center(t.R, t.t).alias("c")).first()
    assert (one.name, one.angle) == ("b", 0.8) and np.allclose(one.R, eye.ravel()) and np.allclose(one.c, [1, 2, 3])
    assert scenes.dataset_rays(t, scenes.read_images(spark, str(tmp_path / "images")), angle=0.8).count() == 12


def mesh(spark, n):
    rng = np.random.default_rng(n)
    v = [(10 * k + 3, *map(float, rng.normal(size=3).round(6)), 0.0, 0.0, 1.0) for k in range(n)]
    f = [(k, *(int(10 * x + 3) for x in rng.choice(n, 3, replace=False))) for k in range(2 * n)]
    return f, v, spark.createDataFrame(f, "fid int, a int, b int, c int").repartition(3), spark.createDataFrame(v, "vid int, x double, y double, z double, nx double, ny double, nz double").repartition(4)


@pytest.mark.parametrize("kind", ["obj", "ply"])
def test_meshes_come_back(spark, tmp_path, kind):
    f, v, faces, vertices = mesh(spark, 50)
    write = meshes.write_obj if kind == "obj" else meshes.write_ply_mesh
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else a small mesh is one part
    write(faces, vertices, str(tmp_path / "parts"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    (tmp_path / f"whole.{kind}").write_text("".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*"))))
    assert len(list((tmp_path / "parts").glob("part-*"))) > 1
    for back, points in (meshes.read_mesh(spark, str(tmp_path / "parts"), kind), meshes.read_mesh(spark, str(tmp_path / f"whole.{kind}"))):
        assert sorted((r.vid, r.x, r.y, r.z, r.nz) for r in points.collect()) == [(k, *x[1:4], 1.0) for k, x in enumerate(v)]
        assert sorted(tuple(r) for r in back.collect()) == [(i, *((x - 3) // 10 for x in abc)) for i, *abc in f]


def test_obj_polygons_and_negative_indices(spark, tmp_path):
    (tmp_path / "x.obj").write_text("# a comment\nmtllib x.mtl\nv 0 0 0\nv 1 0 0\nvt 0 0\nv 1 1 0\nv 0 1 0\n\nf 1/1 2/1 3/1 4/1\nf -4 -3 -2\n")
    faces, vertices = meshes.read_obj(spark, str(tmp_path / "x.obj"))
    assert vertices.count() == 4 and vertices.columns == ["vid", "x", "y", "z"]
    assert sorted(tuple(r) for r in faces.collect()) == [(0, 0, 1, 2), (1, 0, 2, 3), (2, 0, 1, 2)]
    with pytest.raises(ValueError, match="stl"):
        meshes.read_mesh(spark, "x.stl")
    meshes.write_mesh_stats(faces, vertices, str(tmp_path / "stats"))
    assert spark.read.json(str(tmp_path / "stats")).first().n_faces == 3


def test_vertices_of_a_mesh_are_points(spark, tmp_path):
    _, v, faces, vertices = mesh(spark, 9)
    meshes.write_ply_mesh(faces, vertices, str(tmp_path / "m"))
    assert sorted(r.x for r in read_ply(spark, str(tmp_path / "m")).collect()) == sorted(x[1] for x in v)


def test_jobs(spark, tmp_path):
    for job, text in (("one", json.dumps({"job_id": "one", "status": "done"})), ("two", json.dumps({"status": "running"})), ("three", "{broken")):
        (tmp_path / job).mkdir()
        (tmp_path / job / "status.json").write_text(text)
        (tmp_path / job / "other.json").write_text("{}")
    assert sorted(tuple(r) for r in scenes.read_jobs(spark, str(tmp_path)).collect()) == [("one", "done"), ("two", "running")]
    known = spark.createDataFrame([("one", "failed"), ("four", "new")], "job_id string, status string")
    assert sorted(tuple(r) for r in scenes.read_jobs(spark, str(tmp_path), known).collect()) == [("four", "new"), ("one", "failed"), ("two", "running")]
