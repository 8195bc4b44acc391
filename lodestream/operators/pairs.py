"""Near-neighbour pairs whose labels disagree, and the greedy degree cap over them."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.frames import keep_first, materialise, top_n
from lodestream.operators.radius import pairs_within, sound

SAMPLE = 2048
FIRST = 1.0
GROWTH = 4.0
HELD = 400_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_text = lambda c: F.trim(F.coalesce(c, F.lit("")))


def home_bias(df: DataFrame, most: float) -> DataFrame:
    """Ordered pairs of one perspective and cluster within ``most``; the right geography is filled and differs from the
    left one, which may be empty."""
    rows = df.select("perspective", "cluster_id", "ticker", "geo", "pcs")
    named = ["perspective", "cluster_id", "ticker", "geo"]
    # Only rows whose names come again can give a pair of names again: just their pairs are compared.
    repeats = not rows.groupBy(*named).count().filter("count > 1").isEmpty()
    if repeats:
        rows = rows.withColumn("_many", F.count("*").over(Window.partitionBy(*named)) > 1)
    near = pairs_within(rows, ["perspective", "cluster_id"], "pcs", most)
    side = lambda s, t: F.struct(F.col(s).alias("s"), F.col(t).alias("t"))
    both = near.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("_"), "pc_distance").select("_.*", "pc_distance")
    j = both.filter((F.col("s.ticker") != F.col("t.ticker")) & (_text(F.col("t.geo")) != "") & (_text(F.col("s.geo")) != _text(F.col("t.geo"))))
    out = lambda x: x.select(
        "s.perspective", "s.cluster_id", F.col("s.ticker").alias("source_ticker"), F.col("s.geo").alias("source_geo"),
        F.col("t.ticker").alias("alternative_ticker"), F.col("t.geo").alias("alternative_geo"), "pc_distance",
    )
    if not repeats:
        return out(j)
    many = F.col("s._many") | F.col("t._many")
    return out(j.filter(~many)).unionByName(out(j.filter(many)).distinct())


def hidden_twins(df: DataFrame, labels: list[str], most: float, least: int = 2) -> DataFrame:
    """Unordered pairs of a cluster within ``most`` that differ in ``least`` labels both of which are filled."""
    rows = df.select("perspective", "cluster_id", "ticker", "pcs", *[_text(F.col(c)).alias(c) for c in labels])
    near = pairs_within(rows, ["perspective", "cluster_id"], "pcs", most).filter("a.ticker <> b.ticker")
    swap = F.col("a.ticker") > F.col("b.ticker")
    j = near.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), "pc_distance")
    unlike = [(F.col(f"a.{c}") != "") & (F.col(f"b.{c}") != "") & (F.col(f"a.{c}") != F.col(f"b.{c}")) for c in labels]
    n = reduce(lambda p, q: p + q, [u.cast("int") for u in unlike])
    told = F.concat_ws("|", *[F.when(u, F.concat(F.lit(f"{c}:"), F.col(f"a.{c}"), F.lit("!="), F.col(f"b.{c}"))) for c, u in zip(labels, unlike, strict=True)])
    j = j.withColumn("mismatch_count", n).filter(F.col("mismatch_count") >= least)
    return j.select("a.perspective", "a.cluster_id", F.col("a.ticker").alias("ticker_a"), F.col("b.ticker").alias("ticker_b"), told.alias("label_mismatch"), "mismatch_count", "pc_distance")


def degree_capped(edges: DataFrame, a: str, b: str, order: list[str], cap: int = 10, taken: DataFrame | None = None) -> DataFrame:
    """What a scan of the edges in ``order`` keeps when an edge needs both ends below ``cap`` kept edges.

    Done in rounds instead of one fold: an edge is certain to be kept when it is among the first (cap - kept) left at
    either end, and certain to go when an end is full. Every round settles at least the first edge left, in practice most.
    ``order`` with (a, b) must be a total order. ``taken`` holds what was kept of edges that come before all of these.
    """
    keys = [*order, a, b]
    left = materialise(edges)
    while True:
        ends = left.select(F.col(a).alias("v"), *keys).union(left.select(F.col(b).alias("v"), *keys))
        ranked = ends.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(*[F.col(f"`{k}`") for k in keys])))
        if taken is not None:
            kept = taken.select(F.col(a).alias("v")).union(taken.select(F.col(b).alias("v"))).groupBy("v").agg(F.count("*").alias("kept"))
            ranked = ranked.join(kept, "v", "left")
        else:
            ranked = ranked.withColumn("kept", F.lit(0).cast("long"))
        room = F.lit(cap) - F.coalesce("kept", F.lit(0))
        state = ranked.groupBy(*keys).agg(F.min((F.col("r") <= room).cast("int")).alias("keep"), F.max((room <= 0).cast("int")).alias("full"))
        state = materialise(left.join(state, keys))
        # Only the state of a round is written: what is taken and what is left are read from it.
        now = state.filter("keep = 1").drop("keep", "full")
        taken = now if taken is None else taken.unionByName(now)
        left = state.filter("keep = 0 and full = 0").drop("keep", "full")
        if left.isEmpty():
            return taken


def _radii(rows: DataFrame, most: float) -> list[float]:
    """Distances up to which about ``FIRST`` pairs a row lie, ``GROWTH`` times as many and so on, then ``most``; told by a
    sample, as any borders give the same edges."""
    count = rows.count()
    told = materialise(rows.filter(sound(F.col("pcs"))).orderBy(F.xxhash64("ticker", "perspective"), "ticker").limit(SAMPLE)).toPandas()
    told = told.assign(d=told["pcs"].map(len)) if len(told) else told
    found = [np.zeros(0)]
    for _, g in told.groupby(["perspective", "cluster_id", "d"]) if len(told) else ():
        x = np.stack(g["pcs"].to_numpy())
        for i in range(len(x) - 1):
            found.append(np.sqrt(((x[i] - x[i + 1 :]) ** 2).sum(1)))
    gaps = np.sort(np.concatenate(found))
    gaps, each = gaps[gaps < most], (count / max(1, len(told))) ** 2
    borders, want = [], FIRST * count
    while want / each < len(gaps) / 2:
        borders.append(float(gaps[int(want / each)]))
        want *= GROWTH
    return sorted({*borders, most})


def home_bias_capped(df: DataFrame, most: float, cap: int) -> DataFrame:
    """``home_bias`` under the degree cap, nearest first, without all its pairs: they are taken ring by ring, and a ticker that
    is full takes no part in the wider rings, as all pairs of a ring come before those of the next."""
    a, b = "source_ticker", "alternative_ticker"
    rows = materialise(df.select("perspective", "cluster_id", "ticker", "geo", "pcs"))
    taken, inner, open_ = None, None, rows
    for outer in _radii(rows, most):
        edges = home_bias(open_, outer)
        got = degree_capped(edges if inner is None else edges.filter(F.col("pc_distance") > inner), a, b, ["pc_distance"], cap, taken)
        taken = materialise(got)
        full = taken.select(F.col(a).alias("ticker")).union(taken.select(b)).groupBy("ticker").count().filter(F.col("count") >= cap)
        open_, inner = rows.join(full, "ticker", "left_anti").select(*rows.columns), outer
    return taken


def _nearest(k: int):
    def cut(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["ticker", "pc_distance", "other"], kind="stable").drop_duplicates()
        first = f.drop_duplicates(["ticker", "other"])[["ticker", "other", "pc_distance"]]
        return f.merge(first[first.groupby("ticker").cumcount() < k], on=["ticker", "other", "pc_distance"])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for f in frames:
            held.append(f)
            n += len(f)
            if n >= HELD:
                one = cut(pd.concat(held))
                held, n = [one], len(one)
                if n >= HELD // 2:
                    yield one
                    held, n = [], 0
        if n:
            yield cut(pd.concat(held))

    return work


def context(views: DataFrame, home: DataFrame, twins: DataFrame, k: int = 3) -> DataFrame:
    """(ticker, dominant_cluster, clusters, alternatives) of every ticker of ``views`` (ticker, perspective, cluster_id).

    ``clusters`` holds (perspective, cluster_id), the dominant cluster is the commonest of them, the smallest of ties.
    ``alternatives`` holds the ``k`` nearest (ticker, signal, pc_distance, perspective) of both pair tables, each ticker once; a
    missing distance counts as 999. Without pairs it is empty."""
    view = views.filter("cluster_id is not null").select("ticker", "perspective", "cluster_id").distinct()
    own = view.groupBy("ticker").agg(F.mode("cluster_id", True).alias("dominant_cluster"), F.array_sort(F.collect_list(F.struct("perspective", "cluster_id"))).alias("clusters"))
    side = lambda df, a, b, signal: df.select(F.col(a).alias("ticker"), F.col(b).alias("other"), F.lit(signal).alias("signal"), F.coalesce("pc_distance", F.lit(999.0)).alias("pc_distance"), "perspective")
    alts = side(home, "source_ticker", "alternative_ticker", "home_bias_candidate")
    pair = lambda a, b: F.struct(F.col(a).alias("ticker"), F.col(b).alias("other"))
    either = twins.select(F.explode(F.array(pair("ticker_a", "ticker_b"), pair("ticker_b", "ticker_a"))).alias("_"), "pc_distance", "perspective").select("_.*", "pc_distance", "perspective")
    alts = alts.unionByName(side(either, "ticker", "other", "hidden_twin_candidate")).filter("ticker is not null and other is not null")
    # A task leaves the k nearest of each ticker it has met, so that not all pairs are exchanged.
    alts = alts.mapInPandas(_nearest(k), alts.schema)
    once = keep_first(alts, ["ticker", "other"], F.col("pc_distance"), F.col("signal").desc(), F.col("perspective"))
    best = top_n(once, ["ticker"], k, F.col("pc_distance"), F.col("other"))
    got = best.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("other").alias("ticker"), "signal", "pc_distance", "perspective"))).alias("alternatives"))
    none = F.array().cast(got.schema["alternatives"].dataType)
    return views.select("ticker").distinct().join(own, "ticker", "left").join(got, "ticker", "left").withColumn("alternatives", F.coalesce("alternatives", none))
