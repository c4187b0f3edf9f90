"""Mixing of sources to target weights, with DataFrame operations only.

Documents get hash-random keys; each source is cut at its exact budget of words in key order, after
as many whole epochs as the budget holds. Prefix sums run in two levels: over the totals of key
ranges of a source, then inside each range, so no task sees more than one range of a source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Documents to a range, on average, were all of one source: keys are cut behind so many hex digits.
RANGE_ROWS = 100_000


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size in words and the random key; ties of repeated rows go by size."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target: share of all words dealt by weight, no source above most times its size.

    Capping and resharing until none is above ends at one level: target = least(cap, level * weight).
    Sorted by cap / weight, the level is that of the first source that its own level leaves below its cap.
    """
    one = Window.partitionBy(F.lit(0))  # one row a source
    by_name = one.orderBy(F.col("source").asc_nulls_last())
    by_ratio = one.orderBy("ratio", F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double"))
    w = w.withColumn("cap", F.lit(most) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("total", F.lit(share) * F.sum("source_size").over(one))
    w = w.withColumn("below", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("rest", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.col("total") - F.col("below")) / F.col("rest"))
    w = w.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(one))
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row.

    Sources in code point order, null last, take the weights in turn. Every source takes whole epochs
    and then documents in key order to its exact budget; the document at the cut gives the words that
    are missing. A text that is null or blank has size 0 and gives none. Rows that repeat a doc_id each
    count; reruns agree. Other columns are ignored; an empty table gives an empty result.
    """
    d = materialize(sized(docs, seed), "sizes")
    digits = max(3, math.ceil(math.log(max(1, d.count() / RANGE_ROWS), 16)))
    d = d.withColumn("range", F.substring("key", 1, digits))
    parts = d.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    goal = targets(parts.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    budget = F.round("target").cast("long")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.try_divide(budget, F.col("source_size")))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "goal_source")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("range_before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    parts = parts.join(goal, F.col("source").eqNullSafe(F.col("goal_source"))).select(F.col("source").alias("part_source"), F.col("range").alias("part_range"), "range_before", "source_size", "target", "epochs", "rest")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = out.join(parts, F.col("source").eqNullSafe(F.col("part_source")) & (F.col("range") == F.col("part_range")))
    left = F.col("rest") - F.col("range_before") - F.col("inside")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


ORACLE_BODY = r"""
sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, '')) AS key FROM {docs}),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM sized GROUP BY source),
caps AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM sums),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own FROM caps),
goals AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN own <= ratio THEN own END) OVER () * weight, cap)) AS target FROM levels),
cuts AS (SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs FROM goals),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM placed JOIN cuts ON placed.source IS NOT DISTINCT FROM cuts.source
"""
ORACLE = "WITH " + ORACLE_BODY.format(docs="documents").strip()
