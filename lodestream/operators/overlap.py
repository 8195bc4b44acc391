"""Shared words of every query with every row, in pairs of blocks of bounded size."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.frames import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELLS = 4_000_000
LEAST, MOST, SPREAD = 256, 16_384, 8
MOST_WORDS = 1_000_000


def _postings(texts: list[str], number: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray]:
    words = [[number(w) for w in t.split(" ")] if t else [] for t in texts]
    at = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    flat = np.array([w for ws in words for w in ws], dtype=np.int64)
    return flat[flat >= 0], at[flat >= 0]


def shared(asked: list[str], rows: list[str], cells: int = CELLS) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, counts of shared words): a slice of the queries against all rows, ``cells`` numbers at most (one query
    at least). Texts are distinct words with one space between. Words that many of both sides have go through a matrix
    product, all others through their lists."""
    known: dict[str, int] = {}
    qw, qi = _postings(asked, lambda w: known.setdefault(w, len(known)))
    rw, ri = _postings(rows, lambda w: known.get(w, -1))
    order = np.argsort(rw, kind="stable")
    rw, ri = rw[order], ri[order]
    size, n_rows = len(known), len(rows)
    r_n = np.bincount(rw, minlength=size)
    r_at = np.cumsum(r_n) - r_n
    step = max(1, cells // max(1, n_rows))
    for lo in range(0, len(asked), step):
        a, z = np.searchsorted(qi, [lo, lo + step])
        w, i, n = qw[a:z], qi[a:z] - lo, min(step, len(asked) - lo)
        out = np.zeros((n, n_rows), np.float32)
        heavy = np.bincount(w, minlength=size) * r_n > n * n_rows / 256
        ids = np.flatnonzero(heavy)
        wide = max(1, cells // max(n, n_rows))
        for c in range(0, len(ids), wide):
            col = np.full(size, -1)
            col[ids[c : c + wide]] = np.arange(len(ids[c : c + wide]))
            left, right = np.zeros((n, len(ids[c : c + wide])), np.float32), np.zeros((n_rows, len(ids[c : c + wide])), np.float32)
            for part, at, which in ((left, i, col[w]), (right, ri, col[rw])):
                part[at[which >= 0], which[which >= 0]] = 1
            out += left @ right.T
        w, i = w[~heavy[w]], i[~heavy[w]]
        many = r_n[w]
        end = np.cumsum(many)
        cuts = np.unique(np.searchsorted(end, np.arange(0, end[-1] + cells, cells))) if len(end) else []
        for c, d in zip(cuts, [*cuts[1:], len(w)], strict=False):
            m = many[c:d]
            first = np.repeat(r_at[w[c:d]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            out += np.bincount(np.repeat(i[c:d], m) * n_rows + ri[first], minlength=n * n_rows).reshape(n, n_rows)
        yield lo, out


def best_shared(ids: np.ndarray, asked: list[str], sizes: np.ndarray, items: pd.Series, rows: list[str], k: int) -> pd.DataFrame:
    """Of each query the ``k`` rows with most shared words, at least one; ties to the smaller item."""
    order = items.argsort(kind="stable").to_numpy() if not items.isna().any() else items.reset_index(drop=True).sort_values(na_position="first", kind="stable").index.to_numpy()
    names, rows, n = items.to_numpy()[order], [rows[j] for j in order], len(rows)
    q, r, s = [], [], []
    for lo, m in shared(asked, rows):
        key = m.astype(np.int64) * n + np.arange(n - 1, -1, -1)
        at = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(m), 1))
        got = np.take_along_axis(m, at, axis=1)
        i, j = np.nonzero(got)
        q.append(lo + i), r.append(at[i, j]), s.append(got[i, j])
    i, j = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (q, r))
    return pd.DataFrame({"query_id": ids[i], "item": names[j], "overlap": np.concatenate([*s, np.zeros(0)]).astype(float) / np.maximum(sizes[i], 1)})


def units(x: np.ndarray) -> np.ndarray:
    """Billionths, rounded half up by the decimal digits of the number as Spark's ``round`` does."""
    s = x * 1e9
    low = np.floor(s)
    near = np.abs(s - low - 0.5) < 1e-4
    out = np.where(s - low >= 0.5, low + 1, low)
    if near.any():
        some, at = np.unique(x[near], return_inverse=True)
        out[near] = np.array([float(Decimal(repr(float(v))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP)) for v in some])[at]
    return out


def best_scored(q: pd.DataFrame, r: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best tickers of each query in two blocks, each by its best row: .65 share of the words + .35 of its own score,
    rounded; ties by own score, then ticker and item."""
    out = {c: [] for c in ("query_id", "ticker", "item", "own", "score")}
    if len(q) and len(r):
        r = r.assign(o=r["own"].fillna(np.inf)).sort_values(["ticker", "o", "item"], ascending=[True, False, True], na_position="first", ignore_index=True)
        names, own, some = r["ticker"].to_numpy(), r["o"].to_numpy(), (r["ws"] != "").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        of, sizes = np.repeat(np.arange(len(start)), np.diff([*start, len(r)])), q["n"].to_numpy(float)
        for lo, m in shared(q["ws"].tolist(), r["ws"].tolist()):
            score = np.where(some, 0.65 * (m / sizes[lo : lo + len(m), None]) + 0.35 * own, 0.0)
            u = units(score)
            top = np.maximum.reduceat(u, start, axis=1)
            row = np.minimum.reduceat(np.where(u == top[:, of], np.arange(len(r)), len(r)), start, axis=1)
            pick = np.lexsort((np.broadcast_to(np.arange(len(start)), top.shape), -own[row], -top), axis=1)[:, :k]
            i, j = np.repeat(np.arange(len(m)), pick.shape[1]), np.take_along_axis(row, pick, axis=1).ravel()
            for c, x in (("query_id", q["query_id"].to_numpy()[lo + i]), ("ticker", names[j]), ("item", r["item"].to_numpy()[j]), ("own", r["own"].to_numpy()[j]), ("score", score[i, j])):
                out[c].append(x)
    return pd.DataFrame({c: pd.Series(np.concatenate(xs) if xs else [], dtype=object if c in ("query_id", "ticker", "item") else float) for c, xs in out.items()})


def in_blocks(queries: DataFrame, rows: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Every block of ``queries`` beside every block of ``rows`` (both with words ``ws``): at least ``SPREAD`` blocks of either
    side where they have rows enough, and as many as keep a block under ``MOST`` rows and ``MOST_WORDS`` words on average."""
    sides = [materialise(df.withColumn("_t", F.monotonically_increasing_id())) for df in (queries, rows)]
    told = [df.agg(F.count("*").alias("n"), F.sum(F.octet_length("ws")).alias("b")).first() for df in sides]
    nq, nr = (max(1, min(SPREAD, -(-t["n"] // LEAST)), -(-t["n"] // MOST), -(-(t["b"] or 0) // (6 * MOST_WORDS))) for t in told)
    part = lambda n, name: F.pmod(F.xxhash64("_t"), F.lit(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    q = sides[0].select("*", part(nq, "_q"), every(nr, "_r")).drop("_t")
    r = sides[1].select("*", part(nr, "_r"), every(nq, "_q")).drop("_t")
    return q.groupBy("_q", "_r").cogroup(r.groupBy("_q", "_r")).applyInPandas(work, schema)
