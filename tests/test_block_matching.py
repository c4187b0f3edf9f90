"""Blocks of descriptors: products bound, differences decide; pairs of images that keep few matches go where they meet."""

import numpy as np
import pyarrow as pa
import pytest

from prismlake.operators import matching


def tables(x, y, rng):
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.float64()))
    order = rng.permutation(len(y))
    return pa.table({"query_idx": np.arange(len(x)), "desc": lists(x)}), pa.table({"train_idx": order, "desc": lists(y[order])})


@pytest.mark.parametrize("kind", ["plain", "copies", "far", "near", "huge", "tiny", "infinite"])
def test_two_nearest_are_those_of_all_differences(kind):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(70, 16)), rng.normal(size=(500, 16))
    if kind == "copies":
        y = y[rng.integers(0, 4, 500)]
    if kind == "far":  # products lose all digits that tell these apart
        x, y = x * 1e-6 + 1000, y * 1e-6 + 1000
    if kind == "near":
        y = x[rng.integers(0, 70, 500)] + rng.normal(size=(500, 16)) * 1e-9
    if kind in ("huge", "tiny"):
        x, y = (m * {"huge": 1e30, "tiny": 1e-30}[kind] for m in (x, y))
    if kind == "infinite":
        y[7, 3] = np.inf
    d = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    want = np.argsort(d, axis=1, kind="stable")[:, :2]
    got = matching._least_two(*tables(x, y, rng)).sort_by([("query_idx", "ascending"), ("d", "ascending"), ("train_idx", "ascending")])
    assert np.array(got.column("train_idx")).reshape(-1, 2).tolist() == want.tolist()
    assert np.array(got.column("d")).reshape(-1, 2).tolist() == np.take_along_axis(d, want, axis=1).tolist()


def test_a_block_holds_no_difference_of_all_pairs(monkeypatch):
    rng, asked, exact = np.random.default_rng(5), [], matching._exact
    monkeypatch.setattr(matching, "_exact", lambda x, y, i, j: asked.append(len(i)) or exact(x, y, i, j))
    matching._least_two(*tables(rng.normal(size=(200, 16)), rng.normal(size=(3000, 16)), rng))
    assert 400 <= sum(asked) < 2000


def test_differing_bits_by_blocks(spark):
    rng = np.random.default_rng(6)
    bits = rng.integers(-(2**63), 2**63, (3, 90, 2)).view(np.uint64)
    d = spark.createDataFrame([(i, f, bits[i, f].view(np.int64).tolist()) for i in range(3) for f in range(90)], "img_id int, feat_id int, bits array<long>")
    got = {(r.img_a, r.img_b, r.query_idx): r.least for r in matching.nearest_bits(d, block=20).collect()}
    assert got == {(a, b, q): int(np.bitwise_count(bits[a, q] ^ bits[b]).sum(axis=1).min()) for a in range(3) for b in range(a + 1, 3) for q in range(90)}


def test_verified_matches_search_once(spark):
    rng = np.random.default_rng(7)
    desc = rng.normal(size=(60, 8))
    rows = [(i, f, desc[f].tolist(), float(rng.random()), float(rng.random())) for i in range(3) for f in range(60)]
    d = spark.createDataFrame(rows, "img_id int, feat_id int, desc array<double>, u double, v double")
    near = matching.nearest_two(d, keep=("u", "v"))
    at = {(r[0], r[1]): r[3:] for r in rows}
    for r in near.collect():
        assert (r.u1, r.v1, r.u2, r.v2) == (*at[r.img_a, r.query_idx], *at[r.img_b, r.train_idx])
    kept = matching.match_images(d, near, threshold=100.0)
    assert kept.count() == 180 and kept._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups") == 1
    assert matching.match_images(d, near, threshold=100.0, min_matches=61).count() == 0
