"""Packing into optimal length buckets (operator 7).

A dynamic program over the global length histogram chooses the bucket boundaries that minimise padding; inside each
bucket, batches form under a token budget. Only the histogram reaches the driver: it has a row for each distinct length,
so its size is bounded by the longest text, not by the number of texts. Batches are cut from a global rank in the bucket
that is made of a rank in a shard and the shard's offset, so that a bucket holding most rows is ranked by many tasks.

Defined results: a null text counts as empty (0 tokens); a text longer than the budget is a batch of its own; equal rows
are separate; an empty table gives no batches; other columns pass through inside ``row``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.common import staged, table

BUCKETS = 16
BUDGET = 65_536


def n_words(text: Column) -> Column:
    """Token count by white space; any other integer column can take its place."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def optimal_bounds(histogram: list[tuple[int, int]], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    The cost of a bucket over the lengths i+1..j is concave in the quadrangle sense, so the best split moves only to the
    right and each layer is solved by divide and conquer in n log n steps, exactly.
    """
    hist = sorted((int(a), int(b)) for a, b in histogram)
    n = len(hist)
    if n <= buckets:
        return [a for a, _ in hist]
    length = np.array([a for a, _ in hist], dtype=np.float64)
    count = np.concatenate([[0.0], np.cumsum([float(b) for _, b in hist])])
    total = np.concatenate([[0.0], np.cumsum([float(a) * b for a, b in hist])])
    best = np.concatenate([[0.0], length * count[1:] - total[1:]])  # one bucket
    cut = np.zeros((buckets, n + 1), dtype=np.int64)
    for layer in range(1, buckets):
        now = np.full(n + 1, np.inf)
        now[0] = 0.0
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            cost = best[i] + length[mid - 1] * (count[mid] - count[i]) - (total[mid] - total[i])
            at = int(np.argmin(cost))
            now[mid], cut[layer, mid] = cost[at], i[at]
            todo += [(lo, mid - 1, a, int(i[at])), (mid + 1, hi, int(i[at]), b)]
        best = now
    bounds, j = [], n
    for layer in range(buckets - 1, -1, -1):
        if j == 0:
            break
        bounds.append(int(length[j - 1]))
        j = int(cut[layer, j]) if layer else 0
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, shards: int | None = None) -> DataFrame:
    """(row, n_tokens, bucket, bucket_len, batch_id, slot): every row of ``docs`` in exactly one batch."""
    shards = shards or max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = n_words(F.col(text_col)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    sized = staged(docs.select(size.alias("n_tokens"), F.struct("*").alias("row")), "sized")
    hist = [(r["n_tokens"], r["n"]) for r in sized.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()]
    bounds = optimal_bounds(hist, buckets)
    per = [max(1, budget // max(1, b)) for b in bounds]
    held = [sum(n for t, n in hist if lo < t <= hi) for lo, hi in zip(([-1] + bounds)[:-1], bounds, strict=True)]
    start = np.concatenate([[0], np.cumsum([-(-h // p) for h, p in zip(held, per, strict=True)])]).astype(int).tolist()
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values or [0]]).cast("array<bigint>"), F.col("bucket"))
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds or [0]]).cast("array<bigint>"), lambda b: b < F.col("n_tokens")))
    dealt = sized.select("*", bucket.alias("bucket"), F.xxhash64(f"row.{id_col}", "n_tokens").alias("order")).withColumn("shard", F.pmod("order", F.lit(shards)).cast("int"))
    # At most buckets x shards rows, whatever the input: small enough to broadcast.
    offsets = dealt.groupBy("bucket", "shard").agg(F.count("*").alias("n"))
    offsets = offsets.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("offset"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("order", f"row.{id_col}")) - 1)
    rank = F.col("rank") + F.col("offset")
    return ranked.join(F.broadcast(offsets), ["bucket", "shard"]).select(
        "row", "n_tokens", "bucket", pick(bounds).alias("bucket_len"),
        (pick(start[:-1]) + F.floor(rank / pick(per))).cast("long").alias("batch_id"),
        (rank % pick(per)).cast("int").alias("slot"),
    )


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Length buckets and batches of all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", n_words(F.col("text")).alias("words"))
    return pack(sized, tokens=F.col("words")).select("row.doc_id", "n_tokens", "bucket", "bucket_len", "batch_id", "slot")
