"""Structured Streaming forms of the news aggregates and of retrieval per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators.retrieval import similar

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENTS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def daily_scores(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Events and mean score per day; a day closes once the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("events"), F.avg("value").alias("mean_score")).select(F.to_date("w.start").alias("day"), "events", "mean_score")


def distinct_events(events: DataFrame, late: str = "2 days") -> DataFrame:
    """First delivery of each event id; the state is bounded by the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def user_sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """Sessions of a user that a silence of ``gap`` ends."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"), F.sum("value").alias("value")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events", "value")


def retrieve_batches(queries: DataFrame, corpus: DataFrame, k: int, sink, checkpoint: str):
    """Each micro-batch of queries against a static corpus; ``sink(df, batch_id)`` must be idempotent by batch id."""

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(similar(batch, corpus, k), batch_id)

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
