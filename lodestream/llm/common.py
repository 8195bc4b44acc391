"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, SparkSession] = {}


def ship(module_name: str) -> None:
    """Send a module's functions to Python workers by value, so that workers need not import it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset and Spark runs in one process (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = next((k for k, s in _ROOTS.items() if s is spark), None) or "file://" + tempfile.mkdtemp(prefix="lodestream-")
        _ROOTS[root] = spark
    return root.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage so that a lost executor costs one stage, evaluates expensive columns once, and forgets the
    partitioning, so that later joins bring their own exchange, which AQE can split when a key is hot.
    """
    spark = df.sparkSession
    # One folder a run, to be removed once the application has ended.
    path = f"{scratch_root(spark)}/lodestream-{spark.conf.get('spark.app.id')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    import shutil

    for root in _ROOTS:
        shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where ``body`` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def offsets(sizes: Column, chunk: int = 256) -> Column:
    """Sums of the elements before each one of an int array. Folds over chunks, then over the sums of chunks: a fold copies
    its array at each step, so one over all of a long array would take quadratic time."""
    empty = F.array().cast("array<int>")
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    within = lambda at: F.aggregate(F.slice(sizes, at + 1, F.lit(chunk)), F.struct(F.lit(0).alias("at"), empty.alias("out")), step)
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(sizes) - 1, F.lit(0)), F.lit(chunk)), within)
    none = F.array().cast("array<struct<base:int,out:array<int>>>")
    walked = F.aggregate(
        chunks, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, c: F.struct((s["at"] + c["at"]).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("base"), c["out"].alias("out")))).alias("out")),
    )
    return F.flatten(F.transform(walked["out"], lambda c: F.transform(c["out"], lambda x: x + c["base"])))


def numbers(values, kind: str = "double") -> Column:
    """A constant array of any length as one literal of the plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
