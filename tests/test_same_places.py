"""Neighbours where many points and queries lie in one place: all are answered, few are compared."""

import numpy as np

from prismlake.operators import clouds


def brute(points, queries, k):
    out = {}
    for i, p in queries:
        d = sorted((float(np.sqrt(((p - q) ** 2).sum())), j) for j, q in points if j != i)
        out[i] = [(j, round(x, 9)) for x, j in d[:k]]
    return out


def found(d):
    out = {}
    for r in d.orderBy("pt_id", "rank").collect():
        out.setdefault(r.pt_id, []).append((r.nn_id, round(r.d, 9)))
    return out


def test_places_are_compared_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    places = rng.integers(0, 4, (12, 3)).astype(float)
    points = [(i, places[i % 12]) for i in range(240)]
    queries = [(-1 - i, places[i % 5] + (0, 30.0, 0)) for i in range(60)]
    frame = lambda rows: spark.createDataFrame([(i, *x.tolist()) for i, x in rows], "pt_id long, x double, y double, z double")
    sizes, write = {}, clouds.Scratch.table
    monkeypatch.setattr(clouds.Scratch, "table", lambda self, df, name: (lambda d: (sizes.setdefault(name, d.count()), d)[1])(write(self, df, name)))
    assert found(clouds.neighbours(frame(points), 3)) == brute(points, points, 3)
    different = len({tuple(x) for x in places.tolist()})
    assert sizes["places"] == 4 * different
    sizes.clear()
    assert found(clouds.neighbours(frame(points), 2, queries=frame(queries))) == brute(points, queries, 2)
    assert sizes["places"] == 2 * different and sizes["levels"] == len({tuple(x.tolist()) for _, x in queries})
