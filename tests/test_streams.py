"""Streams against the same aggregates in batch, over two deliveries and a restart from the checkpoint."""

from lodestream.streaming import news
from pyspark.sql import functions as F


def deliver(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(folder)


def drain(df, out, checkpoint):
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)


def event(i, ts, user=1, value=1.0):
    return (i, f"2024-01-{ts}", user, "click", value, None)


def test_distinct_events_across_a_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    deliver(spark, src, [event(1, "01 00:00:00"), event(2, "01 01:00:00"), event(1, "01 02:00:00")])
    drain(news.distinct_events(news.event_stream(spark, src)), out, cp)
    deliver(spark, src, [event(2, "01 03:00:00"), event(3, "01 04:00:00"), event(None, "01 04:00:00"), event(None, "01 05:00:00")])
    drain(news.distinct_events(news.event_stream(spark, src)), out, cp)
    assert sorted((r.event_id or 0) for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]


def test_user_sessions_equal_batch(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    first = [event(1, "01 00:00:00", 1, 1.0), event(2, "01 00:30:00", 1, 2.0), event(3, "01 02:00:00", 1, 4.0), event(4, "01 00:10:00", 2, 8.0)]
    later = [event(5, "01 00:50:00", 2, 16.0), event(6, "01 02:40:00", 1, 32.0)]
    deliver(spark, src, first)
    drain(news.user_sessions(news.event_stream(spark, src)), out, cp)
    deliver(spark, src, later)
    drain(news.user_sessions(news.event_stream(spark, src)), out, cp)
    # A far event moves the watermark past the sessions above; its own stays open.
    deliver(spark, src, [event(7, "20 00:00:00", 3, 0.0)])
    drain(news.user_sessions(news.event_stream(spark, src)), out, cp)
    deliver(spark, src, [event(8, "20 00:00:01", 3, 0.0)])
    drain(news.user_sessions(news.event_stream(spark, src)), out, cp)
    got = {(r.user_id, str(r.start), r.events, r.value) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "2024-01-01 00:00:00", 2, 3.0), (1, "2024-01-01 02:00:00", 2, 36.0), (2, "2024-01-01 00:10:00", 2, 24.0)}
    batch = {(r.user_id, str(r.start), r.events, r.value) for r in news.user_sessions(spark.read.parquet(src)).collect() if r.user_id < 3}
    assert got == batch
