"""SparkSession factory used by tests, the bench and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "lodestream", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with UTC, AQE and Arrow on; ``conf`` keys use ``__`` for dots."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
