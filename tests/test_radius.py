import numpy as np
import pytest
from lodestream.operators import radius as R


def table(spark, xs, keys):
    return spark.createDataFrame([(i, k, None if x is None else [None if c is None else float(c) for c in x]) for i, (x, k) in enumerate(zip(xs, keys, strict=True))], "id long, k string, v array<double>")


def found(df, most, **kw):
    rows = R.pairs_within(df, ["k"], "v", most, **kw).select("a.id", "b.id", "pc_distance").collect()
    out = {tuple(sorted(r[:2])): r[2] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("d", "block"), [(1, 1024), (2, 7), (5, 40), (12, 1024)])
def test_equals_brute_force(spark, d, block):
    rng = np.random.default_rng(d)
    xs = np.round(rng.normal(size=(300, d)) * np.linspace(9, 1, d), 1)
    xs[50:80] = xs[:30]
    keys = ["big" if i % 3 else f"k{i % 4}" for i in range(300)]
    most = {1: 1.0, 2: 1.0, 5: 4.0}.get(d, 15.0)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if keys[i] == keys[j] and np.sqrt(((xs[i] - xs[j]) ** 2).sum()) <= most}
    got = found(table(spark, xs, keys), most, block=block)
    assert set(got) == want and len(want) > 30


def test_cells_spare_most_pairs_of_a_large_cluster(spark):
    """10^5 rows of one cluster: fewer than one pair in a hundred is compared, and planted partners are found."""
    df = spark.range(100_000).selectExpr("id", "'c' AS k", "id % 50000 AS n").selectExpr(
        "id", "k", "array((xxhash64(n) % 100000) / 100.0D, (xxhash64(n, 1) % 100000) / 100.0D, (xxhash64(n, 2) % 1000) / 100.0D + IF(id >= 50000, 0.05D, 0.0D)) AS v"
    )
    assert R.pairs_compared(df, ["k"], "v", 0.05001) < 100_000**2 / 2 / 100
    out = R.pairs_within(df, ["k"], "v", 0.05001).selectExpr("abs(a.id - b.id) AS gap")
    assert out.filter("gap = 50000").count() == 50_000


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    xs = [None, [], [], [1, 2], [1, 2], [1], [1], [None, 1], [nan, 1], [inf, 0], [1e200, 0], [1e200, 0], [1, 2], [1, 2]]
    keys = ["k"] * 12 + [None, None]
    assert found(table(spark, xs, keys), 0.0) == {(1, 2): 0.0, (3, 4): 0.0, (5, 6): 0.0, (10, 11): 0.0}
    assert found(table(spark, [], []), 1.0) == {}
    assert found(table(spark, [[0.0]] * 4, ["k"] * 4), 0.0) == {(i, j): 0.0 for i in range(4) for j in range(i + 1, 4)}


def test_pairs_travel_without_their_vectors(spark):
    df = table(spark, [[i / 10, 0.0] for i in range(30)], ["k"] * 30)
    out = R.pairs_within(df, ["k"], "v", 0.25)
    assert out.schema["a"].dataType.names == ["id", "k"] and out.count() == 29 + 28
    joins = [x for x in out._jdf.queryExecution().analyzed().toString().split("\n") if "Join Inner" in x]
    assert len(joins) >= 2 and "_x" not in out._jdf.queryExecution().analyzed().toString()
