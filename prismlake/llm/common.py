"""Shared pieces of the text operators: normalisation, written tables, bounded membership filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, materialize, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: One million ids fit a filter of this many bits with an error of 1.5 %; its size is at most 8 MB however many ids it gets.
FILTER_BITS = 1 << 26
BITMAP_BITS = 32768


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: fewer rows to an Arrow batch keep the Python workers small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes (null: empty) and the kept columns; others, clashing or not, stay behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def fold(texts: Iterable[bytes]) -> list[bytes]:
    """Lower-cases A-Z only."""
    return [t.translate(FOLD) for t in texts]


def id_filter(ids: DataFrame, column: str = "doc_id", bits: int = FILTER_BITS) -> DataFrame:
    """A one-hash membership filter as bitmaps of 32768 bits: (bucket, bits), at most bits / 8 bytes in all."""
    slot = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    return ids.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("filter_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("filter_bits"))


def _bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.expr("1").cast("int") * F.pow(F.lit(2), position % 8).cast("int")) != 0


def flagged(rows: DataFrame, ids: DataFrame, column: str, bits: int) -> DataFrame:
    """Adds filter_hit: false where the row's id is not in ids for sure."""
    slot = F.pmod(F.xxhash64(column), F.lit(bits)) + 1
    out = rows.withColumn("filter_slot", slot).withColumn("filter_bucket", F.expr("bitmap_bucket_number(filter_slot)"))
    out = out.join(F.broadcast(id_filter(ids, column, bits)), "filter_bucket", "left")
    return out.withColumn("filter_hit", F.coalesce(_bit(F.col("filter_bits"), F.expr("bitmap_bit_position(filter_slot)")), F.lit(False)))


def maybe_in(rows: DataFrame, ids: DataFrame, column: str = "doc_id", bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose id is in ids, and few others, without a shuffle of the rows.

    The broadcast side is bounded by bits / 8 bytes. With many more ids than bits it lets every row
    through: callers must stay right then, and only shuffle more.
    """
    return flagged(rows, ids, column, bits).where("filter_hit").select(rows.columns)


def without(rows: DataFrame, ids: DataFrame, column: str = "doc_id", bits: int = FILTER_BITS) -> DataFrame:
    """Rows whose id is not in ids: only those that the filter can't clear are shuffled to make sure."""
    marked = flagged(rows, ids, column, bits)
    unsure = marked.where("filter_hit").select(rows.columns).join(ids.select(column).distinct(), column, "left_anti").select(rows.columns)
    return marked.where("NOT filter_hit").select(rows.columns).unionByName(unsure)
