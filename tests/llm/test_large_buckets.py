"""Fingerprints of which so many are near one another that a bucket fills whole Arrow batches."""

import numpy as np

from prismlake.llm import simhash


def test_buckets_larger_than_a_batch(spark):
    rng = np.random.default_rng(4)
    bits = np.repeat(np.unpackbits(rng.integers(0, 256, (1, 16), np.uint8), axis=1), 2600, axis=0)
    for row in bits:
        row[rng.integers(0, 128, rng.integers(1, 6))] ^= 1
    prints = np.unique(np.packbits(bits, axis=1), axis=0)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    got = {bytes(r["print"]): r.n_near for r in simhash.near_counts(spark.createDataFrame([(p.tobytes(),) for p in prints], "print binary")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for p in prints:
        n = np.bitwise_count(prints ^ p).sum(axis=1)
        assert got.get(p.tobytes(), 0) == int(((n > 0) & (n <= simhash.RADIUS)).sum())
