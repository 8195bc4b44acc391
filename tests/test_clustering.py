import numpy as np
import pytest
from lodestream.operators import clustering as K


def table(spark, rows):
    return spark.createDataFrame([(i, c, None if x is None else [None if v is None else float(v) for v in x]) for i, c, x in rows], "id long, c int, x array<double>")


def brute_kmeans(xs, sample, k, seeds):
    """One start after the other."""
    best = None
    for seed in range(seeds):
        centres = K.starts(sample, k, seed)
        for _ in range(K.STEPS):
            near = ((xs[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            cost = ((xs - centres[near]) ** 2).sum()
            moved = np.stack([xs[near == c].mean(0) if (near == c).any() else centres[c] for c in range(k)])
            done = ((moved - centres) ** 2).sum() <= K.CLOSE * sample.var(axis=0).mean()
            centres = moved
            if done:
                break
        if best is None or round(cost, 9) < best[0]:
            best = (round(cost, 9), centres)
    return best[1][np.lexsort(best[1].T[::-1])]


def test_all_starts_in_one_scan_equal_one_after_the_other(spark):
    rng = np.random.default_rng(2)
    xs = np.concatenate([rng.normal(c, 1.0, size=(60, 3)) for c in ((0, 0, 0), (4, 0, 0), (0, 5, 1), (3, 3, 3))])
    df = table(spark, [(i, 0, x) for i, x in enumerate(xs)] + [(900, 0, None), (901, 0, [1, None, 2])]).repartition(3)
    sample = np.stack([r.x for r in df.filter("id < 900").selectExpr("x", "xxhash64(x) AS h").orderBy("h", "x").limit(K.SAMPLE).collect()])
    for k in (1, 3, 4):
        want = brute_kmeans(xs, sample, k, 20)
        assert np.allclose(K.fit_kmeans(df.filter("id < 900").select("x"), k), want, atol=1e-6)
        got = {r.id: r.cluster_id for r in K.best_kmeans(df, k).collect()}
        assert got.pop(900) is None and got.pop(901) is None
        assert [got[i] for i in range(len(xs))] == ((xs[:, None] - want[None]) ** 2).sum(2).argmin(1).tolist()


@pytest.mark.parametrize("block", [7, 50, K.BLOCK])
def test_silhouettes_by_blocks(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), rng.normal(size=4)) for i in range(120)] + [(i, 1, [1000, 1000, 1000, 1000 + i * 1e-7]) for i in range(200, 204)] + [(300, 9, [1, 1, 1, 1])]
    df = table(spark, [*rows, (301, None, [1, 1, 1, 1]), (302, 1, None)])
    got = {r.id: r.silhouette for r in K.silhouettes(df, "id", "c", "x", block).collect()}
    xs, cs = np.array([x for _, _, x in rows], dtype=float), np.array([c for _, c, _ in rows])
    far = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(2))
    for n, (i, c, _) in enumerate(rows):
        own = (cs == c) & (np.arange(len(rows)) != n)
        a, b = far[n][own].mean() if own.any() else None, min(far[n][cs == o].mean() for o in set(cs.tolist()) - {c})
        assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b), abs=1e-9)
    assert len(got) == len(rows)
    plan = K.silhouettes(df, "id", "c", "x", block)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_principal_components_equal_numpy(spark):
    rng = np.random.default_rng(6)
    xs = rng.normal(size=(80, 5)) * [5, 3, 2, 0.1, 0.05]
    out = K.principal_components(table(spark, [(i, 0, x) for i, x in enumerate(xs)])).orderBy("id").collect()
    values, axes = np.linalg.eigh(np.cov(xs, rowvar=False))
    values, axes = values[::-1], axes[:, ::-1]
    n = max(2, int(np.searchsorted(np.cumsum(values / values.sum()), 0.95)) + 1)
    assert np.allclose(np.abs([r.pcs for r in out]), np.abs(xs @ axes[:, :n]), atol=1e-8)


def test_empty_and_alike(spark):
    none = table(spark, [])
    assert K.principal_components(K.standardise(none)).count() == 0 and K.best_kmeans(none, 3).count() == 0
    assert K.silhouettes(none, "id", "c", "x").count() == 0 and K.auto_kmeans(none, "id").count() == 0
    same = K.best_kmeans(table(spark, [(i, 0, [1, 2]) for i in range(5)]), 3, seeds=2)
    assert {r.cluster_id for r in same.collect()} == {0}


def test_silhouettes_send_a_row_to_a_bounded_number_of_blocks(spark):
    df = spark.range(900).selectExpr("id", "id % 3 AS c", "array(double(id % 3), rand(1)) AS x")
    plan = K.silhouettes(df, "id", "c", "x", 10)._jdf.queryExecution().analyzed().toString()
    assert plan.count("sequence(0, 7") == 2, plan


def test_instruments_are_no_broadcast(spark, tmp_path):
    """The part table grows with the input: its keys are merged, whatever the planner thinks of their size."""
    from lodestream.plans import market

    spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(8)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, "b", "t", i) for i in range(1, 5)], "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    for columns in (["ticker", "pcs"], ["ticker", "pcs", "geo", "kind"]):
        v = market.vectors(spark, str(tmp_path)).select(*columns)
        assert "Broadcast" not in v._jdf.queryExecution().executedPlan().toString() and v.count() == 8
