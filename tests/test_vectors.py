import numpy as np
import pytest
from lodestream.frames import top_n
from lodestream.operators import vectors as V
from pyspark.sql import functions as F


def table(spark, rows, id_col, vec_col):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"{id_col} long, {vec_col} array<double>")


def brute_force(queries, corpus, k):
    out = {}
    for q, a in queries:
        scored = sorted((-round(float(np.dot(a, b)), 12), i) for i, b in corpus if len(b) == len(a))[:k]
        out[q] = [i for _, i in scored]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["item"])
    return out


@pytest.mark.parametrize("batch_bytes", [V.BATCH_BYTES, 600])
def test_equals_brute_force_with_ties(spark, batch_bytes):
    rng = np.random.default_rng(3)
    corpus = [(i, rng.integers(-2, 3, 5)) for i in range(400)] + [(i, rng.integers(-2, 3, 2)) for i in range(400, 420)]
    queries = [(i, rng.integers(-2, 3, 5)) for i in range(40)] + [(99, rng.integers(-2, 3, 2)), (100, rng.integers(-2, 3, 3))]
    q, c = table(spark, queries, "query_id", "q"), table(spark, corpus, "item", "v").repartition(3)
    want = {i: xs for i, xs in brute_force(queries, corpus, 7).items() if xs}
    assert found(V.nearest(q, c, 7, batch_bytes=batch_bytes, chunk=50)) == want
    assert found(V.nearest(q, V.clustered(c, cells=6), 7, batch_bytes=batch_bytes, chunk=50, sample=30)) == want


def test_blocks_are_skipped_on_clustered_vectors(spark):
    """Twenty far groups: a query scores the chunks of few of them, and all results are exact."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 10
    corpus = [(i, centres[i % 20] + rng.normal(size=16) * 0.1) for i in range(6000)]
    queries = [(i, corpus[i * 7][1]) for i in range(60)]
    q, c = table(spark, queries, "query_id", "q"), V.clustered(table(spark, corpus, "item", "v"), cells=20)
    told = spark.sparkContext.accumulator(0)
    assert found(V.nearest(q, c, 5, chunk=100, sample=500, told=told)) == brute_force(queries, corpus, 5)
    assert 0 < told.value < len(corpus) * len(queries) / 4


def test_the_corpus_is_not_shuffled(spark):
    """Only the k rows a query and task that a scan returns are exchanged."""
    c = spark.range(1000).select(F.col("id").alias("item"), F.array(F.col("id").cast("double")).alias("v"))
    plan = V.nearest(table(spark, [(1, [1])], "query_id", "q"), c, 3)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInArrow")[1]
    assert plan.count("Exchange") == 1 and "Exchange" not in below


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1, None]), (4, [nan, 1]), (5, [inf, 1]), (6, [1, 2]), (6, [1, 2]), (None, [5, 5]), (7, [1]), (8, [-1, 0])]
    q, c = table(spark, odd, "query_id", "q"), table(spark, odd, "item", "v").withColumn("score", F.lit("x"))
    got = found(V.nearest(q, c, 3))
    assert got == {2: [2], 6: [6, 6, 8], 7: [7], 8: [8, 6, 6]}
    assert V.nearest(q.limit(0), c, 3).count() == 0 and V.nearest(q, c.limit(0), 3).count() == 0 and V.clustered(c.limit(0)).count() == 0
    assert top_n(V.nearest(q, c, 3).drop("rank"), ["query_id"], 1, F.col("score").desc()).count() == 4
