"""Orientation of normals sends no table through the driver."""

from prismlake.operators import surfaces


def test_no_join_is_broadcast(spark, monkeypatch):
    plans = []
    note = lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString())
    write, last = surfaces.Scratch.table, surfaces.materialize
    monkeypatch.setattr(surfaces.Scratch, "table", lambda self, df, name: (note(df), write(self, df, name))[1])
    monkeypatch.setattr(surfaces, "materialize", lambda df, name: (note(df), last(df, name))[1])
    n = spark.createDataFrame([(0, [0.0, 0.0, 1.0]), (1, [0.0, 0.1, -1.0]), (2, [0.0, 0.0, 1.0]), (3, [1.0, 0.0, 0.0])], "pt_id long, n array<double>")
    near = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "pt_id long, nn_id long")
    got = {r.pt_id: r.n[2] > 0 for r in surfaces.orient_normals(n, near).collect() if r.pt_id < 3}
    assert got == {0: True, 1: True, 2: True}
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("BroadcastHashJoin" in p for p in plans)
