"""Triangulation and its tests over batches of rows, with nulls, and camera matrices made once a camera."""

import numpy as np
from pyspark.sql import functions as F

from prismlake.operators import kernels as K
from prismlake.plans.kernel_queries import good_points, two_views

EYE, KM = np.eye(3), np.array([[800.0, 0, 320], [0, 800, 240], [0, 0, 1]])


def pixel(p, t):
    q = KM @ (p + t)
    return (q[:2] / q[2]).tolist()


def test_nulls_give_no_point_and_no_good_one(spark):
    p, t1, t2 = np.array([0.5, -0.25, 1.0]), np.array([0.0, 0, 4]), np.array([-2.0, 0, 4])
    p1, p2 = ((KM @ np.column_stack([EYE, t])).ravel().tolist() for t in (t1, t2))
    (u1, v1), (u2, v2) = pixel(p, t1), pixel(p, t2)
    rows = [(0, p1, p2, u1, v1, u2, v2), (1, None, p2, u1, v1, u2, v2), (2, p1, p2, None, v1, u2, v2), (3, p1, [None] * 12, u1, v1, u2, v2), (4, p1, p2, u1, v1, u2, v2 + 40)]
    d = spark.createDataFrame(rows, "i long, P1 array<double>, P2 array<double>, u1 double, v1 double, u2 double, v2 double").repartition(1)
    d = d.withColumn("x", K.triangulate(F.col("P1"), F.col("P2"), F.col("u1"), F.col("v1"), F.col("u2"), F.col("v2")))
    got = {r.i: r.x for r in d.collect()}
    assert np.allclose(got[0], p, atol=1e-9) and [got[i] for i in (1, 2, 3)] == [None] * 3
    for n, t in ((1, t1), (2, t2)):
        d = d.withColumns({f"R{n}": F.array(*map(F.lit, EYE.ravel().tolist())), f"t{n}": F.array(*map(F.lit, t.tolist()))})
    k = F.array(*map(F.lit, KM.ravel().tolist()))
    assert [r.i for r in K.good_points(d, k).collect()] == [0]
    assert K.good_points(d, k, degrees=60.0).isEmpty()


def test_matrices_are_made_once_a_camera_and_filters_stay_short(spark, tmp_path):
    path = f"file://{tmp_path}"
    spark.range(3).select(F.col("id").alias("s_suppkey")).write.parquet(f"{path}/supplier.parquet")
    spark.range(20).select(F.col("id").alias("p_partkey"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), (1400 + F.col("id") * 7.0).alias("p_retailprice")).write.parquet(f"{path}/part.parquet")
    spark.range(60).select((F.col("id") % 3).alias("l_suppkey"), (F.col("id") % 20).alias("l_partkey"), F.lit(1.0).alias("l_quantity"), F.lit(0.1).alias("l_discount")).unionByName(spark.sql("SELECT 0L l_suppkey, 1L l_partkey, 1.0D l_quantity, 0.1D l_discount")).write.parquet(f"{path}/lineitem.parquet")
    assert two_views(spark, path).count() == two_views(spark, path, once=True).count() + 1
    plan = good_points(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert max(len(line) for line in plan.splitlines() if "Filter" in line) < 2000
