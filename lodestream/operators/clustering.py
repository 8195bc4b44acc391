"""Scaling, PCA, k-means and silhouettes over vectors."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.frames import materialise
from lodestream.operators.radius import sound

SAMPLE = 4096
STEPS = 40
CLOSE = 1e-4
BLOCK = 1024
SPREAD = 8
MOST = 32_768
CELLS = 4_000_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def standardise(df: DataFrame, column: str = "x") -> DataFrame:
    """Zero mean, population deviation 1; constant dimensions become 0. One aggregate, then a projection."""
    d = df.select(F.size(column).alias("d")).first()
    if d is None:
        return df
    stats = df.agg(*[f(F.get(column, F.lit(i))).alias(f"{n}{i}") for i in range(d["d"]) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    z = F.array(*[(F.get(column, F.lit(i)) - stats[f"m{i}"]) / stats[f"s{i}"] if stats[f"s{i}"] else F.lit(0.0) for i in range(d["d"])])
    return df.withColumn(column, z)


def principal_components(df: DataFrame, column: str = "x", share: float = 0.95) -> DataFrame:
    """Adds ``pcs``: as many components as explain ``share`` of the variance, at least 2."""
    one = df.select(F.size(column).alias("d")).first()
    if one is None:
        return df.withColumn("pcs", F.col(column).cast("array<double>"))
    d = one["d"]
    v = df.withColumn("_v", array_to_vector(column))
    model = PCA(k=d, inputCol="_v", outputCol="_p").fit(v)
    total, n = 0.0, 0
    for r in model.explainedVariance.toArray():
        n += 1
        total += r
        if total >= share:
            break
    n = min(max(n, 2), d)
    return model.transform(v).withColumn("pcs", F.slice(vector_to_array("_p"), 1, n)).drop("_v", "_p")


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By a matrix product; where that loses digits, between close rows, from their difference."""
    scale = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    square = scale - 2 * x @ y.T
    i, j = np.nonzero(square < 1e-5 * scale)
    for at in range(0, len(i), 65536):
        a, b = i[at : at + 65536], j[at : at + 65536]
        square[a, b] = ((x[a] - y[b]) ** 2).sum(1)
    return np.sqrt(np.maximum(square, 0))


def _sums(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Of each row of one block, the sum of distances to the rows of each label in another, those of its own key left out;
    for each place ``t`` of the labels. A slice of the rows at a time."""
    out = {"n": [np.zeros(0, np.int64)], "t": [np.zeros(0, np.int64)], "lj": [np.zeros(0, np.int64)], "sum": [np.zeros(0)], "rows": [np.zeros(0, np.int64)]}
    if len(a) and len(b):
        x, y, ls, hs = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy()), np.stack(b["ls"].to_numpy()), b["h"].to_numpy()
        own = [np.unique(ls[:, t], return_inverse=True) for t in range(ls.shape[1])]
        member = np.zeros((len(b), sum(len(u) for u, _ in own)))
        at = np.cumsum([0, *(len(u) for u, _ in own)])
        for t, (_, which) in enumerate(own):
            member[np.arange(len(b)), at[t] + which] = 1
        places, labels = np.repeat(np.arange(len(own)), np.diff(at)), np.concatenate([u for u, _ in own])
        step = max(1, CELLS // len(b))
        for lo in range(0, len(a), step):
            far = _distances(x[lo : lo + step], y)
            same = a["h"].to_numpy()[lo : lo + step, None] == hs[None, :]
            far[same] = 0
            rows = member.sum(0) - same @ member if same.any() else np.broadcast_to(member.sum(0), (len(far), member.shape[1]))
            total = far @ member
            i, c = np.nonzero(rows)
            for name, v in (("n", a["n"].to_numpy()[lo + i]), ("t", places[c]), ("lj", labels[c]), ("sum", total[i, c]), ("rows", rows[i, c].astype(np.int64))):
                out[name].append(v)
    return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()})


def _silhouettes(rows: DataFrame, block: int) -> DataFrame:
    """(n, t, silhouette) of every row and every one of its labels. ``rows`` (n, h, ls, x), written."""
    count = rows.count()
    blocks = max(1, -(-count // MOST), min(SPREAD, -(-count // block)))
    own = F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = rows.select("n", "h", "x", own.alias("p"), every.alias("q"))
    b = rows.select(F.col("h").alias("h"), F.col("ls").alias("ls"), F.col("x").alias("x"), own.alias("q"), every.alias("p"))
    parts = a.groupBy("p", "q").cogroup(b.groupBy("p", "q")).applyInPandas(_sums, "n long, t int, lj long, sum double, rows long")
    mean = parts.groupBy("n", "t", "lj").agg((F.sum("sum") / F.sum("rows")).alias("d"))
    j = rows.select("n", F.posexplode("ls").alias("t", "l")).join(mean, ["n", "t"], "left")
    r = j.groupBy("n", "t").agg(F.min(F.when(F.col("l") == F.col("lj"), F.col("d"))).alias("a"), F.min(F.when(F.col("l") != F.col("lj"), F.col("d"))).alias("b"))
    return r.select("n", "t", F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def silhouettes(df: DataFrame, key: str, label: str, column: str, block: int = BLOCK) -> DataFrame:
    """Exact Euclidean silhouette of every row: (key, label, silhouette).

    Rows are dealt into up to ``SPREAD`` blocks of at least ``block`` rows, or as many as keep a block under ``MOST``; a pair of
    blocks meets as matrix products of bounded slices, which leave one sum a row and label. The work is
    all pairs by definition, so this is for instrument tables; a row travels once a block, memory is that of two blocks. Defined results: rows without a
    sound vector or a label are in none; a row alone in its cluster, or without another cluster, has 0; rows of one key do
    not count for each other; an empty table gives none."""
    rows = df.select(F.struct(key, label).alias("row"), F.xxhash64(key).alias("h"), F.array(F.xxhash64(label)).alias("ls"), F.col(column).cast("array<double>").alias("x"), F.col(label).alias("_l"))
    rows = materialise(rows.filter(sound(F.col("x")) & F.col("_l").isNotNull()).drop("_l").withColumn("n", F.monotonically_increasing_id()))
    return rows.select("n", "row").join(_silhouettes(rows, block), "n").select("row.*", "silhouette")


def starts(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows of the sample, each drawn by its squared distance from those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    gap = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        chosen.append(int(rng.choice(len(sample), p=gap / gap.sum())) if gap.sum() > 0 else int(rng.integers(len(sample))))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances (rows, starts, centres)."""
    s, k, d = centres.shape
    flat = centres.reshape(s * k, d)
    return np.maximum((x * x).sum(1)[:, None] + (flat * flat).sum(1)[None, :] - 2 * x @ flat.T, 0).reshape(len(x), s, k)


def _partial(shared):
    """Of each start and cluster: rows, cost and the sum of the vectors in this task."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = shared.value
        s, k, d = centres.shape
        rows, cost, total = np.zeros((s, k)), np.zeros((s, k)), np.zeros((s, k, d))
        for f in frames:
            if not len(f):
                continue
            x = np.stack(f["x"].to_numpy())
            gaps = _gaps(x, centres)
            near = gaps.argmin(2)
            for i in range(s):
                member = np.zeros((len(x), k))
                member[np.arange(len(x)), near[:, i]] = 1
                rows[i] += member.sum(0)
                cost[i] += (member * gaps[:, i]).sum(0)
                total[i] += member.T @ x
        at = [(i, c) for i in range(s) for c in range(k)]
        yield pd.DataFrame({"s": [i for i, _ in at], "c": [c for _, c in at], "rows": rows.ravel(), "cost": cost.ravel(), "total": list(total.reshape(s * k, d))})

    return work


def fit_kmeans(vectors: DataFrame, k: int, seeds: int = 20, steps: int = STEPS) -> np.ndarray:
    """The centres of the lowest cost over ``seeds`` starts, in the order of their coordinates. ``vectors`` (x), all of one length.

    All starts move together: a step is one scan, in which every task adds up its rows by start and cluster, and only these
    sums are exchanged; a start rests once its centres move less than ``CLOSE`` of the mean variance. Starts are drawn from at most ``SAMPLE`` rows (smallest hash first); a cluster without rows keeps its centre."""
    spark = vectors.sparkSession
    told = materialise(vectors.orderBy(F.xxhash64("x"), "x").limit(SAMPLE)).toPandas()["x"]  # written: a limit alone may send that many rows of every partition
    sample = np.stack(list(told))
    centres = np.stack([starts(sample, k, seed) for seed in range(seeds)])
    cost, close = np.zeros(seeds), CLOSE * sample.var(axis=0).mean()
    moving = np.arange(seeds)
    add = lambda s, x: F.zip_with(s, x, lambda a, b: a + b)
    for _ in range(steps):
        parts = vectors.mapInPandas(_partial(spark.sparkContext.broadcast(centres[moving])), "s int, c int, rows double, cost double, total array<double>")
        # One array a task is gathered for each start and cluster.
        whole = F.reduce(F.collect_list("total"), F.array_repeat(F.lit(0.0), sample.shape[1]), add).alias("total")
        moved = centres.copy()
        cost[moving] = 0
        for r in parts.groupBy("s", "c").agg(F.sum("rows").alias("rows"), F.sum("cost").alias("cost"), whole).collect():
            at = moving[r["s"]]
            cost[at] += r["cost"]
            if r["rows"]:
                moved[at, r["c"]] = np.array(r["total"]) / r["rows"]
        moving = moving[((moved - centres)[moving] ** 2).sum((1, 2)) > close]
        centres = moved
        if not len(moving):
            break
    best = centres[int(np.argmin(np.round(cost, 9)))]
    return best[np.lexsort(best.T[::-1])]


def best_kmeans(df: DataFrame, k: int, column: str = "x", seeds: int = 20) -> DataFrame:
    """Adds ``cluster_id``: k-means of the lowest cost over several starts, clusters numbered by their centres' coordinates.
    Rows without a sound vector have none; an empty table stays empty."""
    good = sound(F.col(column))
    x = materialise(df.filter(good).select(F.col(column).cast("array<double>").alias("x")))
    if x.isEmpty():
        return df.withColumn("cluster_id", F.lit(None).cast("int"))
    centres = fit_kmeans(x, k, seeds)

    @F.pandas_udf("int")
    def place(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), -1)
        have = vectors.notna().to_numpy()
        if have.any():
            out[have] = _gaps(np.stack(vectors[have].to_numpy()), centres[None])[:, 0].argmin(1)
        return pd.Series(out)

    return df.withColumn("cluster_id", F.when(good, place(F.when(good, F.col(column).cast("array<double>")))))


def auto_kmeans(df: DataFrame, key: str, column: str = "x", ks=range(2, 7), least_share: float = 0.03, seeds: int = 20, n_clusters: int = 4) -> DataFrame:
    """The k of the best mean silhouette whose smallest cluster is not below the share; ties keep the smaller k. Under six rows, or where no
    k passes, it is ``n_clusters``, or what the rows allow."""
    n = df.count()
    if not n:
        return df.withColumns({"cluster_id": F.lit(None).cast("int"), "selected_k": F.lit(None).cast("int")})
    if n < 6:
        k = min(n_clusters, max(2, n - 1))
        return best_kmeans(df, k, column, seeds).withColumn("selected_k", F.lit(k))
    named, passed = df, []
    for k in (k for k in ks if k < n):
        one = best_kmeans(named, k, column, seeds).withColumnRenamed("cluster_id", f"_c{k}")
        if one.groupBy(f"_c{k}").count().agg(F.min("count")).first()[0] >= max(1, int(least_share * n)):
            named, passed = one, [*passed, k]
    if passed:
        # One run over all pairs for every k: the distances are the same, only the labels differ.
        named = materialise(named.withColumn("_n", F.monotonically_increasing_id()))
        labelled = named.filter(sound(F.col(column))).select(F.col("_n").alias("n"), F.xxhash64(key).alias("h"), F.array(*[F.xxhash64(f"_c{k}") for k in passed]).alias("ls"), F.col(column).cast("array<double>").alias("x"))
        scores = {r["t"]: r["s"] for r in _silhouettes(labelled, BLOCK).groupBy("t").agg(F.avg("silhouette").alias("s")).collect()}
        k = passed[max(range(len(passed)), key=lambda t: (scores.get(t, -2.0), -t))]
        out = named.withColumn("cluster_id", F.col(f"_c{k}")).drop("_n", *[f"_c{x}" for x in passed])
    else:
        k = min(n_clusters, n - 1)
        out = best_kmeans(df, k, column, seeds)
    return out.withColumn("selected_k", F.lit(k))
