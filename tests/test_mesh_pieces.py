"""Loose pieces of a mesh."""

import duckdb

import __spark_entry__ as entry
from prismlake.operators import meshes

SMALL = "/root/testdata/sf0.01"


def test_small_components_go(spark):
    wide, rows, faces = 15, [], []
    for i in range(wide):
        rows += [(i * wide + j, float(i), float(j), 0.0) for j in range(wide)]
    for i in range(wide - 1):
        for j in range(wide - 1):
            p, q, r, s = i * wide + j, i * wide + j + 1, (i + 1) * wide + j, (i + 1) * wide + j + 1
            faces += [(len(faces), p, q, r), (len(faces) + 1, q, s, r)]
    body = len(faces)  # 392: components of fewer than 3.92 faces go
    rows += [(1000 + k, 50.0 + k // 2, float(k % 2), 0.0) for k in range(6)] + [(2000 + k, 90.0 + k // 2, float(k % 2), 0.0) for k in range(5)]
    faces += [(body + k, 1000 + k, 1001 + k, 1002 + k) for k in range(4)]  # a strip of four stays
    faces += [(body + 10 + k, 2000 + k, 2001 + k, 2002 + k) for k in range(3)]  # a strip of three goes
    faces += [(body + 20, 1, 1000, 2000)]  # meets all others in points only, and goes
    v = spark.createDataFrame(rows, "vid long, x double, y double, z double")
    f = spark.createDataFrame(faces, "fid long, a long, b long, c long")
    assert {r.fid for r in meshes.clean(f, v).collect()} == set(range(body + 4))
    assert meshes.clean(f, v, ratio=0.0).count() == len(faces)


def test_query_agrees_with_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SMALL}/part.parquet'")
    got = sorted(tuple(x) for x in entry.queries()["h6_mesh_clean"](spark, SMALL).collect())
    assert got == sorted(con.execute(entry.oracle_sql()["h6_mesh_clean"]).fetchall())


def test_query_keeps_loose_pieces_where_keys_have_gaps(spark, tmp_path):
    """Of keys 0 to 299 and 3,060 the last one's face wraps to an edge within the strip: it falls into a large and two small pieces."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE p_partkey WHEN 300 THEN 3060 ELSE p_partkey END AS p_partkey) FROM '{SMALL}/part.parquet' WHERE p_partkey <= 300) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got = sorted(tuple(x) for x in entry.queries()["h6_mesh_clean"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(entry.oracle_sql()["h6_mesh_clean"]).fetchall()) and 3060 in {x[0] for x in got}
