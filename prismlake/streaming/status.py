"""The status of jobs from a stream of their events: the stream's twin of the latest-status query.

Events have job_id, status, updated_at and event_id. Late events are taken up to a watermark; state is
one row a job, and one a job and window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_status(events: DataFrame) -> DataFrame:
    """job_id, status, updated_at: each job's last event so far, ties by event_id. Write it in update or complete mode."""
    last = F.max(F.struct("updated_at", "event_id", "status")).alias("x")
    return events.groupBy("job_id").agg(last).select("job_id", "x.status", "x.updated_at")


def status_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, status, n: events of each window, given out once no more of it can come."""
    n = events.withColumn("updated_at", F.col("updated_at").cast("timestamp")).withWatermark("updated_at", late).groupBy(F.window("updated_at", window), "status").agg(F.count("*").alias("n"))
    return n.select(F.col("window.start").alias("start"), "status", "n")
