"""Streams against the same events as a table."""

from pyspark.sql import functions as F

from prismlake.streaming import status

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_streams_agree_with_the_table(spark, tmp_path):
    e = spark.read.parquet(EVENTS).select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), "event_id")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = status.latest_status(stream).writeStream.format("memory").queryName("last_status").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("last_status").collect())) == sorted(map(tuple, status.latest_status(e).collect()))
    whole = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = status.status_counts(whole).writeStream.format("memory").queryName("counts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.start, r.status): r.n for r in e.groupBy(F.window("updated_at", "1 hour").alias("w"), "status").count().select("w.start", "status", F.col("count").alias("n")).collect()}
    got = {(r.start, r.status): r.n for r in spark.table("counts").collect()}
    assert got.items() <= want.items() and len(got) > 0.8 * len(want)
