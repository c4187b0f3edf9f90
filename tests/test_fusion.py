"""Volumes of signed distances and their surfaces."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.operators import fusion, meshes


def analytic(spark, n, distance):
    """A volume whose distances are known."""
    grid = spark.range(n**3).select(*(((F.floor(F.col("id") / n**k) % n).cast("long") - n // 2).alias(a) for k, a in enumerate(fusion.AXES)))
    return grid.withColumn("tsdf", distance(*(F.col(a) for a in fusion.AXES)))


def test_a_sphere_is_closed_and_turned_outwards(spark):
    volume = analytic(spark, 16, lambda x, y, z: F.sqrt((x - 0.3) ** 2 + y * y + (z + 0.2) ** 2) / 5.2 - 1)
    faces, vertices = fusion.extract_mesh(volume, 0.1)
    q = meshes.quality(faces, vertices).first()
    assert q.watertight and q.euler == 2 and q.volume == pytest.approx(4 / 3 * np.pi * 0.52**3, rel=0.05) and q.n_vertices == vertices.count()
    c = meshes.corners(faces, vertices).collect()
    pa, pb, pc = (np.array([r[k] for r in c]) for k in ("pa", "pb", "pc"))
    outward = (np.cross(pb - pa, pc - pa) * ((pa + pb + pc) / 3 - (0.03, 0, -0.02))).sum(axis=1)
    assert (outward > -1e-12).all()
    p = np.array([tuple(r) for r in fusion.extract_points(volume, 0.1).collect()])
    assert len(p) > 100 and np.abs(np.linalg.norm(p - (0.03, 0, -0.02), axis=1) - 0.52).max() < 0.01


def test_a_volume_with_holes_has_faces_of_whole_cubes_only(spark):
    volume = analytic(spark, 6, lambda x, y, z: x + 0.5).where("NOT (ix = 0 AND iy = 0 AND iz = 0)")
    faces, vertices = fusion.extract_mesh(volume, 1.0)
    assert faces.count() == 8 * (25 - 4) and {r.x for r in vertices.collect()} == {-0.5}
    assert fusion.extract_mesh(volume.limit(0), 1.0)[0].count() == 0 and fusion.extract_points(volume.limit(0), 1.0).count() == 0
    with pytest.raises(Exception, match="too many voxels"):
        fusion.extract_mesh(volume.withColumn("ix", F.col("ix") + (1 << 20)), 1.0)


def test_two_views_of_a_plane(spark):
    """A wall at z = 2, seen from the origin and from 0.3 to the right."""
    pixels = [(i, u, v, 2.0, 10 * i, None if (u, v) == (5, 5) else 1) for i in (0, 1) for u in range(40) for v in range(30)] + [(0, 99, 99, None, 0, 0), (1, 99, 99, -1.0, 0, 0), (0, 98, 98, 77.0, 0, 0)]
    d = spark.createDataFrame(pixels, "img_id int, u int, v int, d double, red int, other int")
    eye = np.eye(3).ravel().tolist()
    cams = spark.createDataFrame([(0, eye, [0.0, 0.0, 0.0]), (1, eye, [-0.3, 0.0, 0.0])], "img_id int, R array<double>, t array<double>")
    volume = fusion.integrate(d, cams, (40.0, 19.5, 14.5), 0.05, 0.2, 5.0, ("red",))
    rows = volume.collect()
    assert len(rows) > 500
    for r in rows:
        z = r.iz * 0.05
        assert r.tsdf == pytest.approx(min(1, (2 - z) / 0.2), abs=1e-5) and 2 - z >= -0.2 - 1e-9 and r.weight in (1, 2) and r.red == {1: r.red, 2: 5.0}[r.weight]
        for i, shift in ((0, 0.0), (1, -0.3)):
            u, v = np.floor((r.ix * 0.05 + shift) / z * 40 + 20), np.floor(r.iy * 0.05 / z * 40 + 15)
            if r.weight == 2:
                assert 0 <= u < 40 and 0 <= v < 30
    again = fusion.integrate(d.repartition(7), cams, (40.0, 19.5, 14.5), 0.05, 0.2, 5.0, ("red",)).collect()
    assert sorted(rows) == sorted(again)
    points, faces, vertices = fusion.fuse(d, cams, (40.0, 19.5, 14.5), 0.05, 0.2, 5.0, ("red",))
    assert {round(r.z, 4) for r in points.collect()} == {2.0} and {round(r.z, 4) for r in vertices.collect()} == {2.0} and faces.count() > 100


def test_images_add_up_in_their_task(spark, monkeypatch):
    """Images meet one by one: no voxel of an image is a row, and halves, null colours and repeated pixels count as ever."""
    monkeypatch.setattr(fusion, "HELD", 3)
    pixels = [(i, u, v, 2.0, None if i % 2 else 0.5) for i in range(8) for u in range(20) for v in range(20)] + [(3, 7, 7, 2.0, None)]
    d = spark.createDataFrame(pixels, "img_id long, u long, v long, d double, red double")
    cams = spark.createDataFrame([(i, np.eye(3).ravel().tolist(), [0.0, 0.0, 0.0]) for i in range(8)], "img_id long, R array<double>, t array<double>")
    out = fusion.integrate(d, cams, (20.0, 9.5, 9.5), 0.1, 0.2, 5.0, ("red",))
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    assert len(rows) > 500 and {r.weight for r in rows} == {8, 9}
    assert all(r.red == 0.5 * 4 / r.weight and r.tsdf == pytest.approx(min(1, (2 - r.iz * 0.1) / 0.2), abs=1e-5) for r in rows)
    assert fusion.integrate(d.limit(0), cams, (20.0, 9.5, 9.5), 0.1, 0.2, 5.0, ("red",)).count() == 0
