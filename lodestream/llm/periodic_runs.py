"""Periodic runs of words: found, and collapsed to their first period (operator 13).

A run is a stretch of words with smallest period q, at least ``LEAST`` words and ``POWER`` periods long, that no neighbour
extends. Words are named by number, then stretches of 2, 4, 8, ... words by the pair of names of their halves (Karp, Miller
and Rosenberg), in NumPy, until no name of a level occurs twice. How far two positions agree follows from the names alone,
level by level downwards. In a run, words q apart agree over a stretch of POWER - 1 periods, so every run covers a whole
window of 2**k <= 2 q words that starts at a point of a grid whose step is the rest of that stretch. For each level k the
grids of all its q are compared at once; points whose window agrees with the one q later are extended to both sides. Of
equal stretches the smallest q stays, as any other is its multiple. Candidates of a level are fewer than the words, so a
text of n words takes O(n log n) memory and O(n log^2 n) time. Texts are judged each by itself: nothing is shuffled.

Defined results: words are what lies between the bytes of ``str.split`` for ASCII; a null text has no runs (an empty list)
and collapses to null, an empty one to an empty text; equal texts have equal runs; an empty table gives an empty one; the
new columns are the last, in place of those of their names in any case, and other columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import let, ship, table

LEAST = 6
POWER = 4
FOUND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def name_levels(ids: np.ndarray) -> list[np.ndarray]:
    """Level k names the stretches of 2**k ids by where they start; the last level is the last with a repeated name."""
    levels = [ids]
    while (n := len(levels[-1]) - (half := 1 << len(levels) - 1)) > 1:
        below = levels[-1]
        found, names = np.unique(below[:n] * (int(below.max()) + 1) + below[half:], return_inverse=True)
        if len(found) == n:
            break
        levels.append(names)
    return levels


def agree_after(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many ids from i on equal those from j on, i < j."""
    far = np.zeros_like(i)
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        last = len(names) - 1
        same = (j + far <= last) & (names[np.minimum(i + far, last)] == names[np.minimum(j + far, last)])
        far += same.astype(far.dtype) << k
    return far


def agree_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many ids before i equal those before j, i < j."""
    far = np.zeros_like(i)
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        a, b = i - far - (1 << k), j - far - (1 << k)
        same = (a >= 0) & (names[np.maximum(a, 0)] == names[np.clip(b, 0, len(names) - 1)])
        far += same.astype(far.dtype) << k
    return far


def find_runs(ids: np.ndarray, least: int = LEAST, power: int = POWER) -> np.ndarray:
    """Rows (start, length, period) by start, then period. ``ids``: whole numbers from 0; ``power`` of 3 or more."""
    n, found = len(ids), [np.zeros((0, 3), dtype=np.int64)]
    levels = name_levels(ids) if n >= least else []
    for k in range(1, len(levels)):
        wide, names = 1 << k, levels[k]
        q = np.arange(wide >> 1, min(wide, n // power + 1), dtype=np.int64)
        step = np.maximum(least, power * q) - q - wide + 1  # the stretch that agrees is step + wide - 1 ids long at least
        points = np.maximum(0, (n - q - wide) // step + 1)
        first = np.cumsum(points) - points
        i = (np.arange(points.sum()) - np.repeat(first, points)) * np.repeat(step, points)
        q = np.repeat(q, points)
        on = names[i] == names[i + q]
        i, q = i[on], q[on]
        start = i - agree_before(levels, i, i + q)
        found.append(np.stack([start, i + q + agree_after(levels, i, i + q) - start, q], axis=1))
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= np.maximum(least, power * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), dtype=bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(text: bytes, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, bytes]:
    """The runs of a text, and its words without those that a run repeats, joined by one space."""
    words = text.split()  # of bytes: at ASCII white space alone
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    runs = find_runs(ids, least, power)
    if len(runs):
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
        np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return runs, b" ".join(words)


def periodic_runs(df: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed", least: int = LEAST, power: int = POWER) -> DataFrame:
    """``df`` with the runs of ``text_col`` (an array of start, length and period in words) and the collapsed text."""
    if power < 3 or least < 4:
        raise ValueError("runs have 3 periods and 4 words or more")

    @F.arrow_udf(FOUND)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            runs, out, sizes = [np.zeros((0, 3), dtype=np.int64)], [], [0]
            for t in texts.cast(pa.binary()).to_pylist():
                some, text = (runs[0], None) if t is None else collapse(t, least, power)
                runs.append(some)
                out.append(text)
                sizes.append(len(some))
            flat = np.concatenate(runs)
            parts = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), parts), pa.array(out, pa.binary()).cast(pa.string())], ["runs", "collapsed"])

    own = {runs_col.lower(), collapsed_col.lower()}
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns if c.lower() not in own]).alias("row") if set(map(str.lower, df.columns)) - own else F.lit(None).alias("row"), find(df[f"`{text_col}`"].cast("string")).alias("found"))
    return rows.select("row.*", F.col("found.runs").alias(runs_col), F.col("found.collapsed").alias(collapsed_col))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def with_planted_period(doc_id: Column, text: Column) -> Column:
    """The text in which a tenth of all documents repeat a stretch of words from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def edited(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        at = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.when(n > 0, F.array_join(F.transform(words, lambda _, i: F.get(words, at(i))), " ")).otherwise(text)

    return F.when(F.coalesce(h % 10 == 0, F.lit(False)), let(words_of(text), edited)).otherwise(text)


ship(__name__)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents``, after the planted period: their number, the strongest, and digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = periodic_runs(docs.select("doc_id", with_planted_period(F.col("doc_id"), F.col("text")).alias("text")))
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))
    out = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
