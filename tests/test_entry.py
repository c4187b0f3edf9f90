import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_give_rows(spark):
    for name in ("c4_world_camera_round_trip", "d9_voxel_downsample", "n10_volume_render", "h9_mesh_quality", "g13_pose_graph_degrees"):
        assert entry.queries()[name](spark, SMALL).count() > 0
