import pytest

from prismlake.sources.ply import read_ply, read_ply_faces, write_ply


def test_ply_round_trip(spark, tmp_path):
    rows = [(k, k * 0.5, -float(k), 1 / 3, 10 * k, 300, 5) for k in range(20)]
    d = spark.createDataFrame(rows, "id int, x double, y double, z double, r int, g int, b int").repartition(3)
    write_ply(d, str(tmp_path / "parts"), "id")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "parts").glob("part-*")))
    (tmp_path / "cloud.ply").write_text(whole)
    parts = read_ply(spark, str(tmp_path / "parts")).collect()
    back = read_ply(spark, str(tmp_path / "cloud.ply")).collect()
    assert len(list((tmp_path / "parts").glob("part-*"))) > 1 and sorted(parts) == sorted(back)
    assert len(back) == 20 and [r.x for r in back] == [r[1] for r in rows] and back[1].z == 0.333333
    assert [r.red for r in back] == [10 * k for k in range(20)] and back[0].green == 255


def test_long_header_and_faces_over_many_splits(spark, tmp_path):
    head = ["ply", "format ascii 1.0", *(f"comment {k}" for k in range(500)), "element vertex 3000", "property double x", "property int id", "element face 2", "property list uchar int vertex_indices", "end_header"]
    body = [f"{k / 7:.6f} {k}" for k in range(3000)] + ["3 0 1 2", "4 5 6 7 8"]
    (tmp_path / "mesh.ply").write_text("\n".join([*head, *body]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        d = read_ply(spark, str(tmp_path / "mesh.ply"))
        assert d.rdd.getNumPartitions() > 3 and sorted((r.id, r.x) for r in d.collect()) == [(k, round(k / 7, 6)) for k in range(3000)]
        assert sorted((r.fid, r.vertices) for r in read_ply_faces(spark, str(tmp_path / "mesh.ply")).collect()) == [(0, [0, 1, 2]), (1, [5, 6, 7, 8])]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "no.ply").write_text("ply\nformat ascii 1.0\n")
    with pytest.raises(ValueError, match="no end"):
        read_ply(spark, str(tmp_path / "no.ply"))
