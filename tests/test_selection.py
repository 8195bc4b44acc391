import math
import random

import numpy as np
import pytest
from lodestream import frames
from lodestream.operators import selection as S
from pyspark.sql import functions as F


def brute_force(xs, p):
    xs = sorted(xs)
    at = (len(xs) - 1) * p
    a, b = xs[math.floor(at)], xs[math.ceil(at)]
    return a if a == b else (math.ceil(at) - at) * a + (at - math.floor(at)) * b


@pytest.mark.parametrize(("few", "borders"), [(1, 2), (3, 5), (50, 8), (S.FEW, S.BORDERS)])
def test_equals_brute_force_at_any_size(spark, few, borders):
    rng = random.Random(few)
    groups = {
        "even": [rng.random() for _ in range(700)], "ties": [float(rng.choice([1, 2, 2, 2, 3])) for _ in range(500)], "one": [7.0], "same": [5.0] * 300,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(400)], "two": [1.0, 4.0], "heavy": [0.0] * 400 + [rng.gauss(0, 1) for _ in range(90)],
    }
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("none", None), (None, 3.0), ("even", None)]
    rng.shuffle(rows)
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    got = {r[0]: r[1:] for r in S.quantiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", shares, few, borders).collect()}
    assert got.keys() == groups.keys()
    for g, xs in groups.items():
        assert list(got[g]) == [brute_force(xs, p) for p in shares], g


def test_equals_the_built_in_on_a_long_column(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), F.when(F.col("id") % 3 == 0, 1.5).otherwise(F.pow(F.xxhash64("id") % 1000 / 97.0, 3)).alias("x"))
    want = df.agg(F.percentile("x", F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98)))).first()[0]
    np.testing.assert_allclose(S.quantiles(df, "g", "x", [0.02, 0.5, 0.98]).first()[1:], want, rtol=1e-15)


def test_no_task_holds_a_column(spark):
    """Neither plan has an aggregate that gathers the values of a group."""
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), (None, 2.0)], "g string, x double")
    for out in (frames.impute(df, "x", "g"), frames.winsorise(df, ["x"])):
        plan = out._jdf.queryExecution().toString().lower()
        assert not any(f in plan for f in ("percentile(", "median(", "collect_list(", "collect_set("))
    assert sorted(map(tuple, frames.impute(df, "x", "g").select("x").collect())) == [(1.0,), (1.0,), (2.0,), (3.0,)]


def test_odd_tables(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", nan), ("a", 1.0), ("a", nan)], "g string, x double")
    assert math.isnan(S.quantiles(df, "g", "x", [0.5], 1, 2).first()[1])
    assert S.quantiles(df.limit(0), "g", "x", [0.5]).count() == 0
    assert frames.winsorise(df.limit(0), ["x"]).count() == 0 and frames.impute(df.limit(0), "x", "g").columns == ["g", "x"]
    only = spark.createDataFrame([("a", None), (None, None)], "g string, x double")
    assert [r.x for r in frames.impute(only, "x", "g").collect()] == [r.x for r in frames.winsorise(only, ["x"]).collect()] == [None, None]
