"""Exact top-k search by the threshold algorithm (operator 5).

Candidates are dealt into blocks of about ``block`` rows. A block turns its vectors to the principal axes of their second
moments, which leaves inner products as they are and puts most of a structured table's weight on the first axes. Sorted
lists are kept for the first ``AXES`` of these and one more for the length of the rest of each vector, which bounds what
the remaining axes can add. For a query the lists are read from the end that its sign favours, a depth at a time; every
row met is scored in full by random access, in integers, and reading stops once the k-th best score exceeds the bound, the
score a row would have with the last value read in every list (and a margin for the rounding of the turned values). What
a block returns is exact, so the best k of all blocks' k are exact too. The named query set meets all rows in pairs of a
query block and a candidate block, each of fixed size; no task holds more than one pair.

Defined results: null vectors, and vectors with a null or non-finite component, take no part; vectors are compared only
with vectors of the same length; ties go to the smaller vec_id; a row is its own query's by vec_id; equal query rows
count once; fewer candidates than k give fewer rows; an empty table gives none; scores beyond the range of a long are
the nearest long, and rank as such; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.common import ship, table

K = 5
EVERY = 50
BLOCK = 4096
QUERY_BLOCK = 2048
AXES = 16
LONGS = (-(2**63), 2**63 - 1)


def threshold_search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, read: list | None = None):
    """Yield (query index, row indices, scores) of the k best rows of each query, its own left out. Components are whole
    numbers whose products and sums doubles hold exactly. ``read`` is told how many rows each query scored."""
    m, d = rows.shape
    if not m or not len(queries):
        return
    axes = np.linalg.eigh(rows.T @ rows)[1][:, ::-1] if d else np.zeros((0, 0))
    turned, asked = rows @ axes, queries @ axes
    h = min(AXES, d)
    lists = np.hstack([turned[:, :h], np.linalg.norm(turned[:, h:], axis=1, keepdims=True)])
    wants = np.hstack([asked[:, :h], np.linalg.norm(asked[:, h:], axis=1, keepdims=True)])
    up = np.argsort(lists, axis=0, kind="stable")  # sorted access: each list, read from either end
    lists = np.take_along_axis(lists, up, axis=0)
    depths = []
    t = 8
    while t < m:
        depths.append(t)
        t *= 2
    plus, minus = np.maximum(wants, 0), np.minimum(wants, 0)
    margin = 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max() * max(1, d)
    bounds = np.stack([plus @ lists[m - t] + minus @ lists[t - 1] + margin for t in depths], axis=1) if depths else np.zeros((len(queries), 0))
    for q in range(len(queries)):
        seen = np.zeros(m, dtype=bool)
        best_rows, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=rows.dtype)
        down = wants[q] < 0
        last = 0
        for i, t in enumerate([*depths, m]):
            if t < m:
                met = np.concatenate([up[m - t : m - last, ~down].ravel(), up[last:t, down].ravel()])
                fresh = np.unique(met[~seen[met]])
            else:
                fresh = np.flatnonzero(~seen)
            last = t
            seen[fresh] = True
            fresh = fresh[ids[fresh] != query_ids[q]]
            best_rows = np.concatenate([best_rows, fresh])
            best = np.concatenate([best, rows[fresh] @ queries[q]])
            if len(best) > k:
                reach = np.partition(best, len(best) - k)[len(best) - k]
                on = best >= reach
                best_rows, best = best_rows[on], best[on]
                order = np.lexsort((ids[best_rows], -best))[:k]
                best_rows, best = best_rows[order], best[order]
            if t == m or (len(best) == k and best.min() > bounds[q, i]):
                break
        if read is not None:
            read.append(int(seen.sum()))
        order = np.lexsort((ids[best_rows], -best))[:k]
        yield q, best_rows[order], best[order]


def full_search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """The same for whole numbers of any size (Python's own), every row scored; scores end at the range of a long."""
    for q in range(len(queries)):
        score = np.array([min(LONGS[1], max(LONGS[0], sum(a * b for a, b in zip(x, queries[q], strict=True)))) for x in rows], dtype=np.int64)
        order = np.lexsort((ids, -score.astype(object)))
        order = order[ids[order] != query_ids[q]][:k]
        yield q, order, score[order]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.floor(256.0 * np.stack(column.to_numpy())) if len(column) else np.zeros((0, 0))


def _whole(column: pd.Series) -> np.ndarray:
    """floor(256 x) as Python's whole numbers; 256 is a power of two, so the product is exact in them."""
    return np.array([[math.floor(Fraction(float(x)) * 256) for x in v] for v in column], dtype=object)


def _pair(k: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            qid, cid = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            with np.errstate(over="ignore"):
                q, c = _matrix(left["v"]), _matrix(right["v"])
                exact = max(np.abs(q).max(initial=0), 1) * max(np.abs(c).max(initial=0), 1) * max(1, q.shape[1]) < 2**53
            found = threshold_search(q, qid, c, cid, k) if exact else full_search(_whole(left["v"]), qid, _whole(right["v"]), cid, k)
            out = [pd.DataFrame({"query_id": qid[i], "qh": left["qh"].iloc[i], "vec_id": cid[rows], "score": score.astype("int64")}) for i, rows, score in found]
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "qh": [], "vec_id": [], "score": []}).astype("int64")

    return search


ship(__name__)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` holds."""
    v = F.col("v")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q")).filter(sound & F.col("vec_id").isNotNull()).withColumn("d", F.size("v"))
    sizes = good.agg(F.count("*").alias("n"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    n_c, n_q = max(1, -(-sizes["n"] // block)), max(1, -(-sizes["q"] // query_block))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = good.filter("q").select("d", "vec_id", "v", F.xxhash64("v").alias("qh")).distinct()
    asked = asked.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(n_q)).cast("int").alias("qb"), spread(n_c).alias("cb"))
    rows = good.select("d", "vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_c)).cast("int").alias("cb"), spread(n_q).alias("qb"))
    found = asked.groupBy("d", "qb", "cb").cogroup(rows.groupBy("d", "qb", "cb")).applyInPandas(_pair(k), "query_id long, qh long, vec_id long, score long")
    w = Window.partitionBy("query_id", "qh").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all ``embeddings`` for every vec_id divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


ORACLE = """
WITH e AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
