"""Source views against the query's SQL, on its own tables and on random cameras."""

import duckdb
import numpy as np
import pandas as pd

import __spark_entry__ as entry
from prismlake.operators import poses
from prismlake.operators.bundle import turned

SMALL = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()["d21_source_views"]


def from_sql(rows):
    """What the SQL says of other cameras: its tables of the suppliers' cameras give way to these."""
    names = ["img_id", *(f"r{i}" for i in range(9)), *(f"t{i}" for i in range(3)), *(f"c{i}" for i in range(3))]
    table = pd.DataFrame([(k, *r.ravel(), *t, *(-r.T @ t)) for k, r, t in rows], columns=names)
    con = duckdb.connect()
    con.register("given", table)
    return set(con.execute("WITH cameras AS (SELECT * FROM given), centers AS (SELECT img_id, c0, c1, c2 FROM given)" + SQL[SQL.index(", p AS") :]).fetchall())


def test_all_other_cameras_are_candidates(spark):
    gen = np.random.default_rng(4)
    turns = turned(gen.uniform(0, 1, (60, 3)) * np.where(np.arange(60) % 7 == 0, 3, 0.8)[:, None])
    rows = [(k, turns[k], -turns[k] @ gen.uniform(-12, 12, 3) * (30 if k % 11 == 0 else 1)) for k in range(60)]
    d = spark.createDataFrame([(k, r.ravel().tolist(), t.tolist()) for k, r, t in rows], "img_id int, R array<double>, t array<double>")
    assert {tuple(x) for x in poses.source_views(d).collect()} == from_sql(rows)
    few = {tuple(x) for x in poses.source_views(d.where("img_id < 3")).collect()}
    assert few == from_sql(rows[:3]) and len(few) == 6


def test_query(spark):
    got = {tuple(x) for x in entry.queries()["d21_source_views"](spark, SMALL).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{SMALL}/supplier.parquet'")
    assert got == set(con.execute(SQL).fetchall()) and len(got) == 40


def test_blocks_of_cameras(spark, monkeypatch):
    """Cameras of many blocks, some with the same pose: no pair of cameras is a row."""
    monkeypatch.setattr(poses, "BLOCK", 20)
    monkeypatch.setattr(poses, "PAIRS", 70)
    gen = np.random.default_rng(9)
    turns = turned(gen.uniform(0, 0.6, (90, 3)))
    rows = [(k, turns[k % 50], -turns[k % 50] @ np.array([k % 50 * 0.3, k % 3, 5.0])) for k in range(90)]
    d = spark.createDataFrame([(k, r.ravel().tolist(), t.tolist()) for k, r, t in rows], "img_id long, R array<double>, t array<double>")
    assert {tuple(x) for x in poses.source_views(d).collect()} == from_sql(rows)
