"""The corpus pipeline: five stages over documents, each written as Parquet and read again.

Toxic documents go, of equal texts the one with the largest id stays, of near copies the one with the
smallest, contaminated documents go, and the last stage deals the sources' words to the mix: a row for
each document of which the mix takes words.

All stages take null and empty texts, texts of any length, null and repeated ids, and other columns,
which stay; of an empty table nothing comes out. What the operators say of such rows holds here.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismlake.llm import decontaminate, exact_dedup, jaccard, mixing, toxicity
from prismlake.llm.common import shared_dir, small_batches
from prismlake.session import drop_tables, remove, table, tables_written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Near copies are documents whose sets of five-word shingles are similar by this percentage.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below 0.5; null and empty texts have no gain, and without labels of both kinds nothing is toxic. Each row counts by its own text."""
    small_batches(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, of the largest id; a null id stays only where a group has no other."""
    small_batches(spark)
    return exact_dedup.keep_last(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group that links join; texts without words link with nothing. Rows of one id stay or go together; a row of null id goes where it links with a known one."""
    small_batches(spark)
    return jaccard.keep_first(docs, NEAR_WORDS, NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of which benchmark windows cover less than 5 %, each row by its own text; an empty benchmark hits nothing."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with their words taken; documents of which it takes none are not part of it. A null source is a source."""
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mix_sources)]
#: The first stage scores compression lengths, which SQL can't; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. When a stage is written, the tables of its steps and its input go; the last one's output stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path, mark = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}", tables_written()
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_tables(spark, mark)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
