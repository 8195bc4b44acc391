"""Exact inner-product search: the corpus is read in place, only bounded batches of queries travel.

A batch of queries is broadcast, and every task reads its part of the corpus a chunk at a time, keeping the k best of each
query so far. A chunk's centre, radius and largest norm bound what it can score (Cauchy-Schwarz), so a query that already has
k better rows skips the chunk without touching its vectors. That spares work where the rows of a chunk are alike: ``clustered``
writes a corpus ordered so, once, and lets searches start from the k-th best of a sample, which is never above the true one.
What a task returns is exact, so the best k of all tasks' k are exact too.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.frames import materialise, top_n
from lodestream.operators.radius import sound

CHUNK = 4096
QUERY_ROWS = 1024
BATCH_BYTES = 32 << 20
SAMPLE = 4096
CELLS = 64
SHARD = 100_000
FOUND = "query_id long, item long, score double"


def best_of(row: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of each row by score, ties to the smaller item."""
    order = np.lexsort((item, -score, row))
    row, item, score = row[order], item[order], score[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
    return row[rank < k], item[rank < k], score[rank < k]


class Search:
    """The k best rows of each query among the chunks met so far; all vectors of one length."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.queries, self.k, self.scored = queries, k, 0
        self.norm = np.linalg.norm(queries, axis=1)
        self.least = np.full(len(queries), -np.inf) if floor is None else floor.copy()  # no row below it is among the k best
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def meet(self, rows: np.ndarray, items: np.ndarray) -> None:
        centre = rows.mean(axis=0)
        radius, top = np.linalg.norm(rows - centre, axis=1).max(), np.linalg.norm(rows, axis=1).max()
        with np.errstate(all="ignore"):
            bound = np.minimum(self.queries @ centre + self.norm * radius, self.norm * top)
            skip = bound + 1e-9 * self.norm * (top + radius) + 1e-11 < self.least
        asked = np.flatnonzero(~skip)
        for start in range(0, len(asked), QUERY_ROWS):
            self._score(asked[start : start + QUERY_ROWS], rows, items)

    def _score(self, asked: np.ndarray, rows: np.ndarray, items: np.ndarray) -> None:
        # Twelve decimals, so that equal vectors score alike wherever they stand in the product.
        score = np.round(self.queries[asked] @ rows.T, 12)
        self.scored += score.size
        least = self.least[asked]
        if len(items) > self.k:
            least = np.maximum(least, np.partition(score, len(items) - self.k, axis=1)[:, len(items) - self.k])
        i, j = np.nonzero(score >= least[:, None])
        row, item, found = self.best
        own = np.isin(row, asked)
        new = best_of(np.r_[row[own], asked[i]], np.r_[item[own], items[j]], np.r_[found[own], score[i, j]], self.k)
        self.best = tuple(np.r_[old[~own], fresh] for old, fresh in zip(self.best, new, strict=True))
        count = np.bincount(new[0], minlength=len(self.queries))
        last = np.full(len(self.queries), np.inf)
        np.minimum.at(last, new[0], new[2])
        full = count >= self.k
        self.least[full] = np.maximum(self.least[full], last[full])


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix) of the vectors of each length; there are no nulls."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[starts[at][:, None] + np.arange(d)[None, :]]


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _scan(shared, k: int, chunk: int, told):
    """mapInArrow over (item, v, cell): the k best of each query in this task's rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {d: (ids, Search(matrix, k, floor)) for d, (ids, matrix, floor) in shared.value.items()}
        for batch in batches:
            item, cell = batch.column("item").to_numpy(), batch.column("cell").to_numpy()
            for at, rows in _by_length(batch.column("v")):
                if rows.shape[1] not in searches:
                    continue
                cuts = np.flatnonzero(np.diff(cell[at])) + 1
                for part in np.split(np.arange(len(at)), cuts):
                    for start in range(0, len(part), chunk):
                        some = part[start : start + chunk]
                        searches[rows.shape[1]][1].meet(rows[some], item[at[some]])
        for ids, search in searches.values():
            row, item, score = search.best
            if told is not None:
                told.add(search.scored)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(item), pa.array(score)], ["query_id", "item", "score"])

    return work


def _matrices(frame, id_col: str, vec_col: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) by vector length."""
    out = {}
    for d, part in frame.groupby(frame[vec_col].map(len)):
        out[int(d)] = (part[id_col].to_numpy(np.int64), np.stack(list(part[vec_col])).astype(np.float64).reshape(len(part), int(d)))
    return out


def _vectors(df: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    good = df.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).cast("array<double>").alias(vec_col), *more)
    return good.filter(sound(F.col(vec_col)) & F.col(id_col).isNotNull())


def clustered(corpus: DataFrame, cells: int = CELLS, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(item, v, cell) written in the order of cells, around centres fitted on at most ``sample`` rows (smallest hash of the
    item first). A cell of more than ``SHARD`` rows is dealt over several partitions. Any cells give the same search results."""
    rows = _vectors(corpus, "item", "v")
    told = _matrices(rows.orderBy(F.xxhash64("item")).limit(sample).toPandas(), "item", "v")
    centres = {}
    for d, (_, x) in told.items():
        c = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:cells])]
        for _ in range(5):
            near = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
            c = np.stack([x[near == n].mean(0) if (near == n).any() else c[n] for n in range(len(c))])
        centres[d] = c

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(len(batch), dtype=np.int64)
            for at, x in _by_length(batch.column("v")):
                c = centres.get(x.shape[1])
                if c is not None and len(at):
                    cell[at] = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("v"), pa.array(cell)], ["item", "v", "cell"])

    placed = materialise(rows.mapInArrow(place, "item long, v array<double>, cell long"))
    shards = materialise(placed.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("n")))
    dealt = placed.join(shards, "cell").withColumn("s", F.pmod(F.xxhash64("item"), F.col("n")))
    return materialise(dealt.repartition("cell", "s").sortWithinPartitions("cell").select("item", "v", "cell"))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, batch_bytes: int = BATCH_BYTES, chunk: int = CHUNK, sample: int = SAMPLE, told=None) -> DataFrame:
    """(query_id, item, score, rank): exact top k of ``corpus`` (item, v) by inner product for each of ``queries`` (query_id, q).

    Queries go in batches of about ``batch_bytes``, each of which scans the corpus once. A corpus from ``clustered`` has a
    column ``cell``; then every query starts from its k-th best of at most ``sample`` rows. ``told``, an accumulator, is
    given the number of pairs scored.

    Defined results: null ids, null vectors and vectors with a component that is null or not finite take no part; vectors
    meet those of their length only; ties go to the smaller item; repeated rows of a query count once, repeated items each;
    fewer rows than k give fewer; empty tables give none; other columns are not read."""
    spark = corpus.sparkSession
    cell = F.col("cell").cast("long") if "cell" in corpus.columns else F.lit(0).cast("long")
    rows = _vectors(corpus.select("item", "v", cell.alias("cell")), "item", "v", "cell")
    asked = _vectors(queries, "query_id", "q").distinct()
    size = asked.agg(F.sum(8 * (F.size("q") + 2)).alias("b")).first()["b"] or 0
    batches = max(1, -(-size // batch_bytes))
    sampled = _matrices(rows.orderBy(F.xxhash64("item")).limit(sample).toPandas(), "item", "v") if "cell" in corpus.columns else {}
    found = None
    for b in range(batches):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == b) if batches > 1 else asked
        held = {}
        for d, (ids, q) in _matrices(some.toPandas(), "query_id", "q").items():
            least = None
            if d in sampled and len(sampled[d][0]) >= k:
                first = Search(q, k)
                first.meet(sampled[d][1], sampled[d][0])
                least = first.least
            held[d] = (ids, q, least)
        part = rows.mapInArrow(_scan(spark.sparkContext.broadcast(held), k, chunk, told), FOUND)
        part = top_n(part, ["query_id"], k, F.col("score").desc(), F.col("item"))
        part = materialise(part) if batches > 1 else part
        found = part if found is None else found.unionByName(part)
    return found
