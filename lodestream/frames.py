"""DataFrame helpers that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_OWN: list[str] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder of ``spark.checkpoint.dir`` (our own temporary one where it is unset) and read back."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="lodestream-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = "file://" + _OWN[0]
    # One folder a run, to be removed once the application has ended.
    path = f"{root.rstrip('/')}/lodestream-{spark.conf.get('spark.app.id')}/frame-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first in a stated order; never ``dropDuplicates``, whose choice is arbitrary."""
    return top_n(df, keys, 1, *order).drop("rank")


def top_n(df: DataFrame, keys: list[str], n: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows a key with their rank. Spark cuts each partition's group to n rows before the exchange."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def fair_cap(df: DataFrame, keys: list[str], per_key: int, total: int, *order: Column) -> DataFrame:
    """First rows of each key, then a global cap in the same order."""
    return top_n(df, keys, per_key, *order).orderBy(*order).limit(total)


def latest_snapshot(df: DataFrame, run: str) -> DataFrame:
    """Rows of the lexicographically last run; the maximum is one row and prunes partitions when ``run`` is one."""
    return df.join(F.broadcast(df.agg(F.max(run).alias(run))), run, "left_semi")


def impute(df: DataFrame, column: str, group: str) -> DataFrame:
    """Nulls by the group's median, then by the mean of the column as it was. Medians are selected by ranges and joined
    back, so that no group has to fit into one task."""
    from lodestream.operators.selection import quantiles

    medians = quantiles(df.select(F.coalesce(group, F.lit("UNKNOWN")).alias("_g"), column), "_g", column, [0.5]).toDF("_g", "_m")
    mean = df.agg(F.avg(column).alias("_a"))
    j = df.withColumn("_g", F.coalesce(group, F.lit("UNKNOWN"))).join(medians, "_g", "left").join(F.broadcast(mean))
    return j.withColumn(column, F.coalesce(column, "_m", "_a")).drop("_g", "_m", "_a")


def mean_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    return df.fillna({c: means[c] for c in columns if means[c] is not None})


def winsorise(df: DataFrame, columns: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Clip to exact quantiles where the lower one is below the upper; all columns are selected at once, one row broadcast."""
    from lodestream.operators.selection import quantiles

    tall = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(columns)])).alias("v")).select("v.*")
    found = quantiles(tall, "g", "x", [low, high])
    q = found.agg(*[F.max(F.when(F.col("g") == i, F.col(f"q{n}"))).alias(f"_{c}_{s}") for i, c in enumerate(columns) for n, s in enumerate("lh")])
    j = df.join(F.broadcast(q))
    for c in columns:
        lo, hi = F.col(f"_{c}_l"), F.col(f"_{c}_h")
        j = j.withColumn(c, F.when(F.col(c).isNotNull() & (lo < hi), F.least(F.greatest(c, lo), hi)).otherwise(F.col(c)))
    return j.drop(*q.columns)


def flatten_names(df: DataFrame, separator: str = "|") -> DataFrame:
    """Two-level column names to their first level, of equal ones the first; others stay."""
    seen, cols = set(), []
    for i, c in enumerate(df.columns):
        name = c.split(separator)[0].strip()
        if name not in seen:
            seen.add(name)
            cols.append((i, name))
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{i}").alias(n) for i, n in cols])


def mappable(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both tables, or of the one that is not empty, in one pass; null keys are none."""
    u = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).union(b.select(key, F.lit(0), F.lit(1))).filter(F.col(key).isNotNull())
    sides = u.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    some = sides.agg(F.max("_a").alias("_sa"), F.max("_b").alias("_sb"))
    return sides.join(F.broadcast(some)).filter((F.col("_a") == F.col("_sa")) & (F.col("_b") == F.col("_sb"))).select(key)


def last_of(df: DataFrame, key: str, value: str, *order: Column) -> DataFrame:
    """A lookup table (key, value): of repeated keys the last row in ``order``."""
    return keep_first(df, [key], *[o.desc() for o in order]).select(key, value)


def resolve(df: DataFrame, names: list[str], contains: list[str] = ()) -> str | None:
    """The first column that has one of ``names`` (case-insensitive), else one that contains a token."""
    lower = {c.lower().strip(): c for c in df.columns}
    for n in names:
        if n.lower() in lower:
            return lower[n.lower()]
    return next((c for k, c in lower.items() if any(t in k for t in contains)), None)
