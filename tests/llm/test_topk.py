import numpy as np
from lodestream.llm import topk as T
from pyspark.sql import functions as F


def brute(v, ids, k):
    out = {}
    for i, q in zip(ids, v, strict=True):
        s = sorted((-int(q @ c), j) for j, c in zip(ids, v, strict=True) if j != i)[:k]
        out[i] = [(j, -x) for x, j in s]
    return out


def test_threshold_search_is_exact():
    rng = np.random.default_rng(0)
    for d, m, span in ((3, 400, 3), (8, 900, 40), (1, 50, 2), (64, 300, 90)):
        v = rng.integers(-span, span + 1, (m, d)).astype(float)
        v[: m // 3] = v[0]
        ids = rng.permutation(m)
        want = brute(v, ids.tolist(), 5)
        for q, rows, score in T.threshold_search(v, ids, v, ids, 5):
            assert [(int(ids[r]), int(s)) for r, s in zip(rows, score, strict=True)] == want[int(ids[q])]


def test_it_stops_early_and_leaves_rows_unread():
    v = np.zeros((5000, 4))
    v[:10] = 100 + np.arange(10)[:, None]
    read = []
    (got,) = T.threshold_search(np.ones((1, 4)), np.array([-1]), v, np.arange(5000), 3, read)
    assert got[1].tolist() == [9, 8, 7] and read[0] < 200
    # Structured vectors, as encoders make them: few axes carry most of the weight, in no particular dimension.
    rng = np.random.default_rng(3)
    v = np.floor(256 * (rng.normal(size=(4000, 3)) @ rng.normal(size=(3, 64)) + 0.02 * rng.normal(size=(4000, 64))))
    ids, read = np.arange(4000), []
    for q, rows, score in T.threshold_search(v[:40], ids[:40], v, ids, 5, read):
        s = v @ v[q]
        s[q] = -np.inf
        assert score.tolist() == sorted(s.tolist(), reverse=True)[:5]
    assert np.mean(read) < 0.5 * 4000 and min(read) < 0.1 * 4000


def test_blocks_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 256]) for i in range(120)]
    bad = [(500, None), (550, [1.0, None, 0.0, 0.0]), (600, [float("nan")] * 4), (601, [float("inf")] * 4), (650, [1.0] * 3), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for r in T.top_k(df, F.col("vec_id") % 50 == 0, block=30, query_block=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(np.floor(256 * np.array([v for _, v in rows])), [i for i, _ in rows], 5)
    assert got == {i: want[i] for i in (0, 50, 100)}
    few = spark.createDataFrame(rows[:3], df.schema)
    assert T.top_k(few, F.col("vec_id") == 0).count() == 2
    assert T.top_k(spark.createDataFrame([], df.schema), F.col("vec_id") == 0).count() == 0
    wide = spark.createDataFrame([(i, [1e6 * (i + 1)] * 2) for i in range(3)], df.schema)
    assert T.top_k(wide, F.col("vec_id") == 0).orderBy("rank").first().vec_id == 2


def test_huge_components_and_clashing_columns(spark):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 2.0]), (4, [1e10, 0.0])], schema)
    got = [(r.vec_id, r.score) for r in T.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (4, 2**63 - 1), (3, 512 * 256), (2, -(2**63))]
    extra = df.selectExpr("*", "'v' as v", "1 as q", "2 as d", "3 as qb", "4 as cb", "5 as qh", "6 as score", "7 as rank", "8 as query_id")
    assert T.top_k(extra, F.col("vec_id") == 0).count() == 4
