"""Exact radius join: all pairs of rows within a distance, without comparing all pairs.

Vectors are turned to a few principal axes. No axis shows two rows farther apart than they are, so rows within ``most`` lie
in the same or in neighbouring cells of a grid over the axes that is as wide or wider. It is wider where cells would hold
fewer than about ``ROWS`` rows. Each row is at home in its cell and visits the
cells on one side of it, so every pair of neighbouring cells meets once. The rows at home in a large cell are dealt into
blocks; a block is held as one matrix, and all visitors of the cell pass by it in Arrow batches. The distance itself is computed of what may be near, and
only pairs within ``most`` leave, in slices, with the columns of both rows but for their vectors; pairs are never exchanged. The axes only direct the search: they are fitted on a bounded sample, and any axes
give the same pairs.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestream.frames import materialise

SAMPLE = 4096
AXES = 2
BLOCK = 8192
SPREAD = 8
MOST = 32_768
ROWS = 64
CELLS = 4_000_000
SLICE = 131_072


def sound(v: Column) -> Column:
    """A vector all of whose components are finite numbers."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def principal_axes(vectors: np.ndarray, n: int) -> list[list[float]]:
    """The ``n`` orthonormal directions in which ``vectors`` differ most."""
    if not vectors.size:
        return []
    vectors = vectors / max(1.0, np.abs(vectors).max())
    turned = np.linalg.eigh(np.cov(vectors, rowvar=False).reshape(vectors.shape[1], -1))[1][:, ::-1]
    return turned[:, :n].T.tolist()


def _dealt(rows: DataFrame, keys: list[str], most: float, axes: int) -> DataFrame:
    """``rows`` (keys, _i, _v) with ``_cell``, the grid cell of each."""
    length = F.size("_v")
    common = rows.groupBy(length.alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("_v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))).alias("far")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    told = rows.filter(length == common[0]["d"]).orderBy(F.xxhash64("_i")).limit(SAMPLE).select("_v").toPandas()["_v"] if common else []
    told = np.stack(list(told)) if len(told) else np.zeros((0, 0))
    found = principal_axes(told, axes)
    far = common[0]["far"] if common else 0.0
    width = most * (1 + 1e-6) + 1e-12 * far * (common[0]["d"] if common else 1) or 1.0
    along = lambda axis: F.aggregate(F.zip_with("_v", F.array(*map(F.lit, axis)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    # Vectors of another length have no cell of their own: they meet their like in one.
    parts = max(1.0, common[0]["n"] / ROWS) ** (1 / len(found)) if found else 1.0
    widths = [max(width, float(np.ptp(told @ np.array(axis))) / parts) for axis in found]
    cells = [F.coalesce(F.floor(along(axis) / w), F.lit(0)) for axis, w in zip(found, widths, strict=True)]
    others = [c for c in rows.columns if c not in (*keys, "_i", "_v")]
    return rows.select(*keys, *others, "_i", "_v", length.alias("_d"), F.array(*(cells or [F.lit(0).cast("long")])).alias("_cell"))


def _steps() -> Column:
    """The steps to the cells of one side of a neighbourhood, the own cell first."""
    n = F.size("_cell")
    steps = {m: [s for s in itertools.product((-1, 0, 1), repeat=m) if s >= (0,) * m] for m in range(1, AXES + 1)}
    return F.explode(F.coalesce(*[F.when(n == m, F.array(*[F.array(*[F.lit(x).cast("long") for x in s]) for s in ss])) for m, ss in steps.items()]))


def _met(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(home, visits): each row in its own cell, and in that and the following ones of its neighbourhood."""
    visits = rows.withColumn("_step", _steps())
    same = ~F.exists("_step", lambda x: x != 0)
    home = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own, so that the two sides can meet
    others = [F.col(c).alias(c) for c in rows.columns if c != "_cell"]
    return home, visits.select(*others, F.zip_with("_cell", "_step", lambda a, b: a - b).alias("_cell"), same.alias("_same"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("_v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if len(batch.column("_v").flatten()) else np.zeros((batch.num_rows, 0))


def _near(most: float):
    def close(x: np.ndarray, y: np.ndarray, xi: np.ndarray, yi: np.ndarray, same: np.ndarray) -> Iterator[tuple]:
        """(rows of x, rows of y, distances) within ``most``, of one cell each pair once."""
        step = max(1, CELLS // max(1, len(y)))
        y2 = (y * y).sum(1)
        for at in range(0, len(x), step):
            part = x[at : at + step]
            x2 = (part * part).sum(1)
            gap = x2[:, None] + y2[None, :] - 2 * (part @ y.T)
            far = gap > most * most + 1e-9 * (most * most + x2[:, None] + y2[None, :])  # not: what overflows is measured as well
            i, j = np.nonzero(~far & (~same[None, :] | (xi[at : at + step, None] < yi[None, :])))
            for lo in range(0, len(i), SLICE):
                p, q = i[lo : lo + SLICE] + at, j[lo : lo + SLICE]
                square = np.zeros(len(p))
                for axis in range(x.shape[1]):  # added up in order, as ``columns.distance`` does
                    gone = x[p, axis] - y[q, axis]
                    square += gone * gone
                distance = np.sqrt(square)
                ok = distance <= most
                yield p[ok], q[ok], distance[ok]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by block, those at home first; they are held, the visitors pass by."""
        key, held, home, ready, waiting = None, [], None, [], 0
        told = lambda: pa.RecordBatch.from_arrays([pa.concat_arrays(list(c)) for c in zip(*ready, strict=True)], ["a", "b", "pc_distance"])
        for batch in batches:
            g, p, v = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_g", "_p", "_visit"))
            borders = np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (v[1:] != v[:-1])) + 1
            for lo, hi in itertools.pairwise([0, *borders.tolist(), len(g)]):
                if lo == hi:
                    continue
                if key != (g[lo], p[lo]):
                    key, held, home = (g[lo], p[lo]), [], None
                part = batch.slice(lo, hi - lo)
                if not v[lo]:
                    held.append(part)
                    continue
                if not held and home is None:
                    continue
                if home is None:
                    home = np.concatenate([_matrix(h) for h in held]), np.concatenate([h.column("_i").to_numpy() for h in held]), pa.concat_arrays([h.column("row") for h in held])
                    held = []
                with np.errstate(all="ignore"):
                    for i, j, distance in close(home[0], _matrix(part), home[1], part.column("_i").to_numpy(), part.column("_same").to_numpy(zero_copy_only=False).astype(bool)):
                        if len(i):
                            ready.append((home[2].take(pa.array(i)), part.column("row").take(pa.array(j)), pa.array(distance)))
                            waiting += len(i)
                        if waiting >= SLICE:
                            yield told()
                            ready, waiting = [], 0
        if ready:
            yield told()

    return near


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _blocks(rows: DataFrame, keys: list[str], most: float, axes: int, block: int):
    """(met, sizes): the rows at home and the visitors of every block of a cell; ``sizes`` has the rows of either kind by cell."""
    place = [*keys, "_d", "_cell"]
    home, visits = _met(_dealt(rows, keys, most, axes), keys)
    # Visitors are told from the cells, not from the rows.
    cells = materialise(home.groupBy(*place).agg(F.count("*").alias("_h")))
    there = cells.withColumn("_step", _steps()).select(*[c for c in place if c != "_cell"], F.zip_with("_cell", "_step", lambda a, b: a - b).alias("_cell"), F.col("_h").alias("_n"))
    count = cells.join(there.groupBy(*place).agg(F.sum("_n").alias("_n")), place)
    sizes = materialise(count.withColumn("_g", F.monotonically_increasing_id()))
    # Blocks of ``block`` rows, larger ones where a cell would have more than SPREAD of them.
    shards = F.ceil(F.col("_h") / F.least(F.greatest(F.lit(block), F.ceil(F.col("_h") / SPREAD)), F.lit(MOST))).cast("int")
    a = home.join(sizes, place).select("_g", F.pmod(F.xxhash64("_i"), shards).cast("int").alias("_p"), F.lit(False).alias("_visit"), F.lit(True).alias("_same"), "_i", "row", "_v")
    b = visits.join(sizes, place).select("_g", F.explode(F.sequence(F.lit(0), shards - 1)).alias("_p"), F.lit(True).alias("_visit"), "_same", "_i", "row", "_v")
    return a.unionByName(b), sizes


def pairs_within(df: DataFrame, keys: list[str], vec_col: str, most: float, axes: int = AXES, block: int = BLOCK) -> DataFrame:
    """(a, b, pc_distance): every unordered pair of rows of ``df``, as structs without the vector, that agree in ``keys`` and lie within ``most``, once.

    Defined results: rows with a null key, a null vector or a component that is null or not finite are in no pair; vectors
    meet those of their length only; equal rows are pairs at distance 0; an empty table gives none."""
    axes = max(1, min(axes, AXES))
    numbered = df.withColumn("_i", F.monotonically_increasing_id())
    named = [F.col(f"`{c}`") for c in df.columns if c != vec_col]
    rows = materialise(numbered.select(F.struct(*named).alias("row") if named else F.struct(F.lit(0).alias("_")).alias("row"), "_i", *[F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)], F.col(f"`{vec_col}`").cast("array<double>").alias("_v")))
    own = [f"_k{n}" for n in range(len(keys))]
    good = rows.filter(sound(F.col("_v"))).dropna(subset=own) if own else rows.filter(sound(F.col("_v")))
    met, _ = _blocks(good, own, most, axes, block)
    # Blocks are few bytes and much work, so that Spark may not gather them into fewer tasks.
    spark = df.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = rows.schema["row"].dataType
    out = StructType([StructField("a", row), StructField("b", row), StructField("pc_distance", DoubleType())])
    return met.repartition(parts, "_g", "_p").sortWithinPartitions("_g", "_p", "_visit").mapInArrow(_near(most), out)


def pairs_compared(df: DataFrame, keys: list[str], vec_col: str, most: float, axes: int = AXES) -> int:
    """How many pairs of rows ``pairs_within`` compares."""
    rows = df.select(F.struct(F.lit(0)).alias("row"), *[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.monotonically_increasing_id().alias("_i"), F.col(vec_col).cast("array<double>").alias("_v")).filter(sound(F.col("_v")))
    sizes = _blocks(materialise(rows), [f"_k{n}" for n in range(len(keys))], most, axes, BLOCK)[1]
    return sizes.agg(F.sum(F.col("_h") * F.col("_n"))).first()[0] or 0
