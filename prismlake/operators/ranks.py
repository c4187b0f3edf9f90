"""Places, running sums and exact quantiles of groups of any size: no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

#: Quantiles: buckets to a round of cuts, and rounds.
BUCKETS, ROUNDS = 1024, 2


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """By keys of which null equals null; one row joins without any."""
    if not keys:
        return left.crossJoin(F.broadcast(right))
    other = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_other_{k}"))
    return left.join(other, same, how).drop(*(f"_other_{k}" for k in keys))


def running(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds _n (rows of the group), _at (place in its order, from 1) and _s (sum of value down to the row; null adds nothing).

    Rows are cut into ranges of the order, so a long group is many ranges: windows run within ranges, and what
    lies before a range comes from the sums of ranges. Rows that tie stay in one range, in any order. Null keys
    are a group, null order comes first.
    """
    ranged = rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    # ranges are sampled anew by every job: written, they stay
    ranged = materialize(ranged, "ranges")
    sums = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_m"), F.sum(F.col(value).cast("double")).alias("_v"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_range", F.sum("_m").over(group).alias("_n"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_m0"), F.coalesce(F.sum("_v").over(before), F.lit(0.0)).alias("_v0"))
    own = Window.partitionBy(*by, "_range").orderBy(*order)
    down = F.coalesce(F.sum(F.col(value).cast("double")).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    d = ranged.withColumn("_at", F.row_number().over(own)).withColumn("_s", down)
    d = joined(d, starts, [*by, "_range"])
    return d.withColumns({"_at": F.col("_at") + F.col("_m0"), "_s": F.col("_s") + F.col("_v0")}).drop("_range", "_m0", "_v0")


def _ends() -> list[Column]:
    """The range of values, and of those that are finite."""
    v = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    return [F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.min(v).alias("_least"), F.max(v).alias("_most")]


def _bucket() -> Column:
    """Of equal width between the finite ends; infinite values and NaN lie outside. Halves can't overflow."""
    half = F.greatest(F.col("_most") / (2 * BUCKETS) - F.col("_least") / (2 * BUCKETS), F.lit(1e-300))
    at = F.least(F.floor((F.col("_v") / 2 - F.col("_least") / 2) / half), F.lit(BUCKETS - 1)).cast("int")
    return F.when(F.abs("_v") < float("inf"), at).when(F.col("_v") < 0, -1).otherwise(BUCKETS)


def group_quantile(rows: DataFrame, by: list[str], column: str, share: float) -> DataFrame:
    """by and column: each group's value at a share of its order, interpolated between neighbours; nulls don't count.

    Equal values meet first. Then the range of values that holds the place is cut into buckets of equal width whose
    counts say which one holds it, and that one's own range is cut again: a far value costs a round of cuts, not a task
    that orders all others. What is left is ordered. Groups without values have no row; without keys there
    is one row, null of nothing. Infinite values are in their order, NaN last.
    """
    v = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    held = v.groupBy(*by).agg(*_ends(), F.sum("_n").alias("_total"))
    held = held.select(*by, "_lo", "_hi", "_least", "_most", F.lit(0).cast("long").alias("_before"), (F.lit(share) * (F.col("_total") - 1)).alias("_place"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    for _ in range(ROUNDS):
        d = joined(v, held, by).where("_v BETWEEN _lo AND _hi")
        d = d.groupBy(*by, _bucket().alias("_bucket")).agg(*_ends(), F.sum("_n").alias("_m"), F.first("_before").alias("_before"), F.first("_place").alias("_place"))
        d = d.withColumn("_before", F.col("_before") + F.sum("_m").over(group.orderBy("_bucket")) - F.col("_m"))
        # the bucket of the place, and of the next one if that is another
        d = d.where((F.col("_before") <= F.ceil("_place")) & (F.col("_before") + F.col("_m") > F.floor("_place")))
        held = d.groupBy(*by).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min("_least").alias("_least"), F.max("_most").alias("_most"), F.min("_before").alias("_before"), F.first("_place").alias("_place"))
    last = joined(v, held, by).where("_v BETWEEN _lo AND _hi").withColumn("_last", F.col("_before") + F.sum("_n").over(group.orderBy("_v")) - 1)
    pick = lambda place: F.max(F.when((F.col("_last") - F.col("_n") + 1 <= place) & (F.col("_last") >= place), F.col("_v")))
    one = last.groupBy(*by).agg(pick(F.floor("_place")).alias("_a"), pick(F.ceil("_place")).alias("_b"), F.first("_place").alias("_place"))
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_place") - F.floor("_place"))
    return one.select(*by, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(between).alias(column))
