"""The pipeline's near copies: five words, 80 %."""

import collections
import random

import numpy as np

import corpus_pipeline
from prismlake.llm import jaccard


def keys(sets, percent):
    return {(band, int(k)) for band, _, ks in jaccard.pieces(sets, percent) for k in ks}


def numbers(gen, n):
    return np.unique(gen.integers(0, 1 << 64, n, dtype=np.uint64))


def test_strangers_share_no_key():
    gen = np.random.default_rng(5)
    for n in (40, 100, 400):
        met = collections.Counter(k for _ in range(1000) for k in keys(numbers(gen, n), 80))
        assert max(met.values()) <= 3


def test_all_that_can_link_share_a_key():
    gen, tried = np.random.default_rng(6), 0
    for percent in (80, 90):
        for _ in range(2000):
            a = numbers(gen, int(gen.choice([4, 6, 9, 10, 13, 20, 31, 50, 100, 300])) + int(gen.integers(0, 3)))
            b = a[gen.permutation(len(a))[int(gen.integers(0, len(a) * (100 - percent) // 100 + 1)) :]]
            b = np.union1d(b, numbers(gen, max(0, 100 * len(b) // percent - len(a))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                tried += 1
                assert keys(a, percent) & keys(b, percent)
    assert tried > 1000


def test_near_copies_are_those_of_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for n in (9, 14, 30, 100, 100, 250):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(8):
            d = list(base)
            for at in rng.sample(range(n), rng.randrange(4)):
                d[at] = "changed"
            texts.append(" ".join(d))
    hundred = [rng.choice(words) for _ in range(100)]
    texts += [" ".join(hundred), " ".join("changed" if k in (30, 70) else w for k, w in enumerate(hundred))]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    up = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and up[a] != up[b]:
                low, high = sorted((up[a], up[b]))
                up = [low if u == high else u for u in up]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == set(up) and len(texts) - 1 not in got
