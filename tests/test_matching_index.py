"""The approximate index against the exact way, and matches from descriptors to verification."""

import numpy as np
import pytest

from prismlake.operators import matching


def features(images, n, seed, dim=32):
    """Noisy descriptors of the same things in every image."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    return [(i, f, (base[f] + rng.normal(size=dim) * 0.15).tolist()) for i in range(images) for f in range(n)]


def test_recall_of_random_projections(spark):
    d = spark.createDataFrame(features(3, 300, 1), "img_id int, feat_id int, desc array<double>").repartition(4)
    exact = {(r.img_a, r.img_b, r.query_idx): r for r in matching.nearest_two(d).collect()}
    got = {(r.img_a, r.img_b, r.query_idx): r for r in matching.nearest_two_indexed(d).collect()}
    hit = [k for k in exact if k in got and got[k].train_idx == exact[k].train_idx]
    assert len(exact) == 900 and len(hit) >= 0.9 * len(exact) and all(got[k].d1 == pytest.approx(exact[k].d1) for k in hit)
    assert matching.candidates(d).count() < 0.35 * 3 * 300 * 300


def test_recall_of_bits(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, (200, 256), np.uint8)
    rows = []
    for i in range(2):
        for f in range(200):
            x = base[f] ^ (rng.random(256) < 0.05)
            rows.append((i, f, np.packbits(x.astype(np.uint8)).view(np.int64).tolist()))
    d = spark.createDataFrame(rows, "img_id int, feat_id int, desc array<long>")
    got = {r.query_idx: r for r in matching.nearest_two_indexed(d, packed=True, bits=8).collect()}
    want = {}
    x = np.array([r[2] for r in rows]).view(np.uint8).reshape(2, 200, -1)
    for q in range(200):
        n = np.bitwise_count(x[0, q] ^ x[1]).sum(axis=1)
        want[q] = int(n.argmin()), int(n.min())
    right = [q for q in want if q in got and (got[q].train_idx, got[q].d1) == want[q]]
    assert len(right) >= 0.9 * 200 and matching.candidates(d, packed=True, bits=8).count() < 0.35 * 200 * 200


def test_images_that_share_nothing_are_no_candidates(spark):
    rows = features(2, 100, 1) + [(i + 2, f, x) for i, f, x in features(2, 100, 99)]
    found = matching.candidate_images(spark.createDataFrame(rows, "img_id int, feat_id int, desc array<double>"), 200, bits=12).collect()
    assert {(r.img_a, r.img_b) for r in found} == {(0, 1), (2, 3)}


def test_from_descriptors_to_verified_matches(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(-1, 1, (80, 3)) + (0, 0, 5)
    a = np.radians(12)
    r, t = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]]), np.array([0.6, 0, 0.1])
    rows = []
    for (i, f, desc) in features(2, 80, 7):
        q = p[f] if i == 0 else r @ p[f] + t
        off = rng.uniform(50, 90, 2) if i and f % 8 == 0 else rng.normal(size=2) * 0.3
        rows.append((i, f, desc, *(np.array([800 * q[0] / q[2] + 320, 800 * q[1] / q[2] + 240]) + off).tolist()))
    d = spark.createDataFrame(rows, "img_id int, feat_id int, desc array<double>, u double, v double")
    for near in (matching.nearest_two(d), matching.nearest_two_indexed(d), matching.nearest_two(d, image_pairs=spark.createDataFrame([(0, 1)], "img_a int, img_b int"))):
        got = matching.match_images(d, near).collect()
        assert len(got) > 70 and all(x.query_idx == x.train_idx for x in got)
        wrong = [x for x in got if x.inlier == (x.query_idx % 8 == 0)]
        assert len(wrong) <= 3
    assert matching.match_images(d, matching.nearest_two(d), min_matches=79).count() == 0
