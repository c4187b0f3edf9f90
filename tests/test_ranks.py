"""Running sums and quantiles of groups against NumPy, one group with a third of all rows and more."""

import numpy as np
import pytest

from prismlake.operators import poses, ranks, scenes


def test_group_quantile(spark):
    gen = np.random.default_rng(2)
    crowd = np.concatenate([gen.normal(0, 1, 3000), [1e12, -1e12, float("inf")], np.zeros(500)])
    groups = {"crowd": crowd, "one": np.array([3.5]), "two": np.array([1.0, 2.0]), "same": np.full(40, 7.0), None: gen.uniform(0, 9, 101)}
    d = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("void", None), ("one", None)], "g string, v double")
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.g: r.v for r in ranks.group_quantile(d, ["g"], "v", share).collect()}
        assert got.keys() == groups.keys()
        for k, v in groups.items():
            if k != "crowd" or share < 1:
                assert got[k] == pytest.approx(np.quantile(v, share), rel=1e-12, abs=1e-12), (k, share)
    assert ranks.group_quantile(d.where("g = 'void'"), [], "v", 0.5).collect() == [(None,)]
    assert ranks.group_quantile(d.limit(0), ["g"], "v", 0.5).collect() == []


def test_far_values_leave_little_to_order(spark):
    """One far value pushed all others into one bucket; its range is cut again, and the last step orders few."""
    d = spark.range(20000).selectExpr("CAST(id AS DOUBLE) AS _v").union(spark.createDataFrame([(1e15,)], "_v double"))
    sizes = []
    for _ in range(ranks.ROUNDS):
        cut = d.crossJoin(d.agg(*ranks._ends())).withColumn("b", ranks._bucket())
        most = cut.groupBy("b").count().orderBy("count").tail(1)[0]
        d = cut.where(cut.b == most.b).select("_v")
        sizes.append(most["count"])
    assert sizes[0] == 20000 and sizes[1] < 25
    ends = spark.createDataFrame([(-1.7e308,), (1.7e308,), (0.0,), (5e-324,)], "v double")
    assert ranks.group_quantile(ends, [], "v", 1.0).first().v == 1.7e308 and ranks.group_quantile(ends, [], "v", 0.0).first().v == -1.7e308


def test_running(spark):
    gen = np.random.default_rng(3)
    rows = [("hot" if gen.uniform() < 0.6 else gen.choice(["a", "b", None]), int(k), None if k % 50 == 0 else float(gen.uniform())) for k in gen.permutation(3000)]
    got = ranks.running(spark.createDataFrame(rows, "g string, k int, v double"), ["g"], ["k"], "v").collect()
    assert len(got) == 3000
    for g in ("hot", "a", "b", None):
        own = sorted((k, v or 0.0) for x, k, v in rows if x == g)
        mine = sorted((r.k, r._at, r._n, r._s) for r in got if r.g == g)
        assert [m[:3] for m in mine] == [(k, at, len(own)) for at, (k, _) in enumerate(own, 1)]
        assert [m[3] for m in mine] == pytest.approx(np.cumsum([v for _, v in own]).tolist())
    assert ranks.running(spark.createDataFrame([], "g string, k int, v double"), ["g"], ["k"], "v").collect() == []


def test_curves_of_null_runs_and_statistics_of_nothing(spark):
    d = spark.createDataFrame([(None, k, float(k)) for k in range(6)], "run string, k int, v double")
    got = {r.k: r.smooth for r in scenes.training_curve(d, "run", ["k"], "v", 3).collect()}
    assert got == {k: k - 1.0 for k in range(2, 6)}
    none = spark.createDataFrame([], "cam int, error double")
    assert poses.error_stats(none, "cam").collect() == []
    one = poses.error_stats(none).first()
    assert one.n == 0 and one.mean_error == float("inf") and one.median_error is None
