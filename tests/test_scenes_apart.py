"""Scenes that no observation joins: each is adjusted about cameras of its own."""

import duckdb
import numpy as np

import __spark_entry__ as entry
from prismlake.operators.bundle import turned
from prismlake.operators.kernels import align_similarity
from prismlake.operators.reconstruction import reconstruct

SMALL = "/root/testdata/sf0.001"


def apart(folder):
    """The smallest tables twice, keys of the second copy 5,000 further on."""
    con = duckdb.connect()
    for t, keys in (("supplier", ["s_suppkey"]), ("part", ["p_partkey"]), ("lineitem", ["l_suppkey", "l_partkey"])):
        rep = ", ".join(f"({k} + 5000 * i)::BIGINT AS {k}" for k in keys)
        con.execute(f"COPY (SELECT * REPLACE ({rep}) FROM '{SMALL}/{t}.parquet', range(0, 2) r(i)) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def test_bundle_adjustment_of_two_scenes(spark, tmp_path):
    con = apart(tmp_path)
    got = sorted(tuple(x) for x in entry.queries()["b4_bundle_adjustment"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(entry.oracle_sql()["b4_bundle_adjustment"]).fetchall()) and len(got) > 200


def test_similarities_of_groups(spark):
    rows = [(m, float(x), float(y), float(z), *(2.0 * m * c + m for c in (x, y, z))) for m in (1, 2) for x, y, z in ((0, 0, 0), (1, 0, 0), (0, 2, 0), (0, 0, 3))]
    found = align_similarity(spark.createDataFrame(rows, "m long, a double, b double, c double, d double, e double, f double"), ("a", "b", "c"), ("d", "e", "f"), "m").collect()
    assert sorted((r.m, round(r.scale, 9), [round(x, 9) for x in r.t]) for r in found) == [(1, 2.0, [1.0] * 3), (2, 4.0, [2.0] * 3)]


def test_models_of_two_scenes(spark):
    """Two scenes that no match joins: all images are registered, each scene in its own frame."""
    gen = np.random.default_rng(3)
    k, p, rows = (800.0, 800.0, 320.0, 240.0), gen.uniform(-2, 2, (60, 3)), []
    for i in range(6):
        r, shift = turned(np.array([[0.0, 0.15 * (i % 3), 0.02 * (i % 3)]]))[0], np.array([-1.5 * (i % 3), 0.1, 9.0])
        q = (p if i < 3 else p[:, ::-1]) @ r.T + shift
        rows += [(i, j + 1000 * (i // 3), float(800 * x / z + 320), float(800 * y / z + 240)) for j, (x, y, z) in enumerate(q)]
    d = spark.createDataFrame(rows, "img_id long, feat_id long, u double, v double")
    a, b = d.select("img_id", "feat_id").toDF("img_a", "feat_a"), d.select("img_id", "feat_id").toDF("img_b", "feat_b")
    matches = a.join(b, (a.feat_a == b.feat_b) & (a.img_a < b.img_b)).select("img_a", "feat_a", "img_b", "feat_b")
    found = reconstruct(d, matches, k)
    assert sorted((r.img_id, r.model) for r in found.cameras.collect()) == [(i, i // 3 * 3) for i in range(6)]
    assert found.points.count() == 120
