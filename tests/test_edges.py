"""Edges of suppliers: parts of the joins and counts follow the number of line items."""

from prismlake.plans import pose_queries


def test_parts_follow_the_line_items(spark, tmp_path):
    rows = [(o, s) for o in range(40) for s in {o % 7, o % 5, (o + 3) % 7, o % 7}] * 2
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for o in range(40):
        own = sorted({s for k, s in rows if k == o})
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    for part_rows, parts in ((1000, 4), (10, -(-len(rows) // 10))):
        d = pose_queries.edges(spark, str(tmp_path), part_rows)
        assert {(r.src, r.dst): r.weight for r in d.collect()} == want and d.rdd.getNumPartitions() == parts
