"""Exact quantiles of large columns, by group, without bringing a column or a group into one task.

A round cuts every group at about equally filled borders, which a mergeable sketch finds, and counts exactly what lies
between two borders and on each of them. The counts tell in which of these ranges the wanted ranks lie; only their rows stay
for the next round. A range of one value is an answer, however many rows have it; one of at most ``few`` rows is sorted.
Borders only direct the search, so the results are exact and the same for any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.frames import materialise

FEW = 1 << 16
BORDERS = 32


def ranked_values(rows: DataFrame, wanted: DataFrame, few: int = FEW, borders: int = BORDERS) -> DataFrame:
    """(g, rank, x): the values at the wanted ranks (from 0) of each group. ``rows`` (g, x) and ``wanted`` (g, rank)
    are without nulls and best written tables, as they are read more than once."""
    # _p tells the range within a group, _r the rank within that range.
    left = rows.select("g", F.lit("").alias("_p"), "x")
    asked = wanted.select("g", F.lit("").alias("_p"), "rank", F.col("rank").alias("_r")).distinct()
    found = None
    steps = [F.lit((i + 1) / (borders + 1)) for i in range(borders)]
    while True:
        sizes = left.groupBy("g", "_p").agg(F.count("*").alias("n"), F.percentile_approx("x", F.array(*steps), F.lit(20 * borders)).alias("cuts"))
        sizes = sizes.select("g", "_p", F.when(F.col("n") > few, F.array_distinct("cuts")).otherwise(F.array().cast("array<double>")).alias("cuts"))
        # 2 i: between the borders i - 1 and i; 2 i + 1: on border i. NaN is equal to itself and above all else, as in Spark's order.
        range_of = F.aggregate("cuts", F.lit(0), lambda s, c: s + F.when(F.col("x") > c, 2).when(F.col("x") == c, 1).otherwise(0))
        dealt = materialise(left.join(sizes, ["g", "_p"]).select("g", "_p", range_of.alias("_b"), "x"))
        counts = dealt.groupBy("g", "_p", "_b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        before = F.sum("n").over(Window.partitionBy("g", "_p").orderBy("_b")) - F.col("n")  # at most 2 * borders + 1 rows a range
        hits = asked.join(counts.withColumn("_before", before), ["g", "_p"]).filter((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("n")))
        hits = materialise(hits.select("g", "_p", "_b", "rank", (F.col("_r") - F.col("_before")).alias("_r"), "n", "lo", "hi", (F.col("lo") == F.col("hi")).alias("_one")))
        one = hits.filter("_one").select("g", "rank", F.col("lo").alias("x"))
        place = ["g", "_p", "_b"]
        short = hits.filter(~F.col("_one") & (F.col("n") <= few))
        inside = dealt.join(short.select(*place).distinct(), place, "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy(*place).orderBy("x")) - 1)
        some = one.unionByName(short.join(inside.withColumn("_r", F.col("_r").cast("long")), [*place, "_r"]).select("g", "rank", "x"))
        found = some if found is None else found.unionByName(some)
        long = hits.filter(~F.col("_one") & (F.col("n") > few))
        if long.isEmpty():
            return found
        path = F.concat_ws("/", "_p", F.col("_b").cast("string")).alias("_p")
        left = materialise(dealt.join(long.select(*place).distinct(), place, "left_semi").select("g", path, "x"))
        asked = materialise(long.select("g", path, "rank", "_r"))


def quantiles(df: DataFrame, group: str, column: str, shares: Sequence[float], few: int = FEW, borders: int = BORDERS) -> DataFrame:
    """(g, q0, q1, ...): the exact quantiles of each group, between two values by their distance, as ``percentile`` has them.

    Defined results: null values count nowhere, and a group of them alone is missing; null groups are none; a quantile
    between two equal values is that value; NaN counts as the largest value; an empty table gives none."""
    rows = df.select(F.col(group).alias("g"), F.col(column).cast("double").alias("x")).filter("g is not null and x is not null")
    rows = materialise(rows)
    place = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(p))).alias("at")) for i, p in enumerate(shares)]))
    want = materialise(rows.groupBy("g").agg(F.count("*").alias("n")).select("g", place.alias("w")).select("g", "w.i", "w.at", F.floor("w.at").alias("low"), F.ceil("w.at").alias("high")))
    values = materialise(ranked_values(rows, want.select("g", F.explode(F.array("low", "high")).alias("rank")), few, borders))
    value = lambda rank, name: values.select("g", F.col("rank").alias(rank), F.col("x").alias(name))
    j = want.join(value("low", "a"), ["g", "low"]).join(value("high", "b"), ["g", "high"])
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.col("high") - F.col("at")) * F.col("a") + (F.col("at") - F.col("low")) * F.col("b"))
    return j.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, between)).alias(f"q{i}") for i in range(len(shares))])
