"""Labelled rows for the classifiers: the training fold, and bounded samples of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5


def held_out() -> Column:
    """One row in five never trains: crc32 of the doc_id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y of the training fold; of repeated rows the larger label counts, nulls don't."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))


#: Bytes of text in a sample, at most (and one text more of each label).
SAMPLE_BYTES = 64 << 20


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, most: dict[int | None, int], most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, text, y of at most most[y] rows of each label (of all labels under None), whole texts by the hash of their ids up to most_bytes.

    The sample is what one process fits on; its size is a parameter, whatever the size of the tables.
    """
    fold, picked = training_labels(labels, label), None
    for y, n in most.items():
        part = (fold if y is None else fold.where(F.col("y") == y)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).withColumn("part", F.lit(-1 if y is None else y))
        picked = part if picked is None else picked.unionByName(part)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    before = Window.partitionBy("part").orderBy(F.xxhash64("doc_id"), "doc_id", "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).where(F.col("before") < most_bytes // len(most))
    return rows.select("doc_id", "text", "y")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int | None, int], most_bytes: int = SAMPLE_BYTES) -> list[tuple[int, bytes]]:
    """(y, text) of sample_rows(), in the order of ids and texts, on the driver."""
    return [(r.y, r.text.encode()) for r in sorted(sample_rows(docs, labels, label, most, most_bytes).collect(), key=lambda r: (r.doc_id, r.text))]
