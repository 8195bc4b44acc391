"""Line dedup by winnowing over line hashes (operator 1, native).

The windows are all runs of ``window + 1`` neighbouring lines and all shorter ones of ``min_words`` words or more. Each
window selects its smallest line hash (the first of equal ones) as a fingerprint, so equal windows select equal lines at
equal places, and what a window shares with another is guaranteed to meet in a fingerprint. Neighbouring windows mostly
select the same line, so there are fewer fingerprints than lines.

Fingerprints of one hash are brought together; those met once only are done with, and so are all windows that selected
them. Every other fingerprint is a match whose position is extended both ways, to the borders of each window that selected
it, and the extended run is joined with the first copy of that very run: the first of each distinct context, not of the
bare line. So no pairs are formed however often a line occurs, and of two later texts that share more with each other than
with the first, the longer match is found too. Where an extended run is not the first copy, its lines are deleted; what
overlaps of such runs makes up the longer matches.

"First" is the smallest (id, text hash, line), so a deleted line always has an equal line before it, and the first copy of
any line stays.

Defined results: a null text has no lines and stays null; an empty text stays; null ids come after all others; equal
rows of one id are one document and are kept alike; a document whose lines all occur earlier keeps an empty text, it is
not dropped; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import let, staged, table

WINDOW = 2
MIN_WORDS = 50
_SEED = 0x9E3779B97F4A7C15 - 2**64


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def fingerprints(keyed: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(k, uid, text) to (h, k, uid, pos, runs): the selected lines, each with the runs (n, g, g2, lo) that selected it, as 128-bit hashes."""
    lines = F.split("text", "\n", -1)
    # Two hashes of each line, seeded apart, carry 128 bits into the hash of a run.
    hashed = keyed.filter(F.col("text").isNotNull()).select(
        "k", "uid",
        let(lines, lambda ls: F.struct(F.transform(ls, lambda x: F.xxhash64(x)).alias("h"), F.transform(ls, lambda x: F.xxhash64(F.lit(_SEED), x)).alias("h2"), F.transform(ls, _words).alias("w"))).alias("x"),
    )
    hashed = hashed.select("k", "uid", "x.h", "x.h2", "x.w")

    def run(n: int, before: int, h: Column, p: Column) -> Column:
        """The run of ``n`` lines, ``before`` of them ahead of line ``p``, if it is a window that selects this line; else null."""
        lo = p - before
        at = lambda c: [F.get(c, lo + t) for t in range(n)]
        hs = at(F.col("h"))
        # Outside the text ``get`` is null, and so is the comparison.
        selects = [x > h for x in hs[:before]] + [x >= h for x in hs[before + 1 :]]
        if n <= window:
            ws = at(F.col("w"))
            selects.append(sum(ws[1:], ws[0]) >= min_words)
        found = F.struct(F.lit(n).alias("n"), F.xxhash64(*hs).alias("g"), F.xxhash64(*at(F.col("h2"))).alias("g2"), lo.alias("lo"))
        return F.when(reduce(and_, selects), found) if selects else found

    runs = lambda h, p: F.array_compact(F.array(*[run(n, b, h, p) for n in range(1, window + 2) for b in range(n)]))
    selected = F.filter(F.transform("h", lambda h, p: F.struct(h.alias("h"), p.alias("pos"), runs(h, p).alias("runs"))), lambda s: F.size(s["runs"]) > 0)
    found = hashed.select("k", "uid", F.explode(selected).alias("f"))
    return found.select("f.h", "k", "uid", "f.pos", "f.runs")


def extended(prints: DataFrame) -> DataFrame:
    """(n, g, g2, k, uid, lo): the runs around the fingerprints that were met more than once."""
    met = prints.groupBy("h").count().filter("count > 1").select("h")
    # Written and read again, so that the join has an exchange of its own on both sides: a line that half of all documents
    # share then falls into splits instead of one task.
    return prints.join(staged(met, "met"), "h", "left_semi").select("k", "uid", F.inline("runs")).select("n", "g", "g2", "k", "uid", "lo")


def repeated_runs(runs: DataFrame) -> DataFrame:
    """(k, uid, lo, hi): the runs of lines to delete, by line number."""
    first = runs.groupBy("n", "g", "g2").agg(F.min(F.struct("k", "uid", "lo")).alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    later = runs.join(staged(first, "first"), ["n", "g", "g2"]).filter(F.struct("k", "uid", "lo") != F.col("first"))
    return later.select("k", "uid", "lo", (F.col("lo") + F.col("n") - 1).alias("hi"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, text, n_lines, n_removed): every row of ``docs`` as a struct, with its text less the later repeated runs."""
    uid = lambda i, t: F.xxhash64(i, t)
    order = lambda c: F.coalesce(c.cast("long"), F.lit(2**63 - 1)).alias("k")
    keyed = docs.select(order(F.col(id_col)), uid(F.col(id_col), F.col(text_col)).alias("uid"), F.col(text_col).alias("text"))
    runs = repeated_runs(staged(extended(staged(fingerprints(keyed, window, min_words), "prints")), "runs"))
    gone = runs.distinct().groupBy("k", "uid").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("lo", "hi")))).alias("gone"))
    whole = docs.select(F.struct("*").alias("row")).select("row", order(F.col(f"row.{id_col}")), uid(F.col(f"row.{id_col}"), F.col(f"row.{text_col}")).alias("uid"))
    text = F.col(f"row.{text_col}")
    left = let(
        F.split(text, "\n", -1),
        lambda ls: F.struct(
            F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.coalesce("gone", F.array().cast("array<int>"))), lambda i: F.get(ls, i)), "\n").alias("text"),
            F.size(ls).alias("n"),
        ),
    )
    n_gone = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    lines = F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    # Merged at any size: what is deleted grows with the input, so a broadcast would only serve small ones.
    return whole.hint("merge").join(staged(gone, "gone"), ["k", "uid"], "left").select("row", F.when(F.col("gone").isNull(), text).otherwise(left["text"]).alias("text"), lines.alias("n_lines"), n_gone.alias("n_removed"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``documents`` less later repeated runs of lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("row.doc_id", "text", "n_lines", "n_removed")


ORACLE = r"""
WITH l AS (SELECT doc_id, i, line, length(line) - length(replace(line, ' ', '')) + 1 AS w
  FROM (SELECT doc_id, unnest(ls) AS line, CAST(unnest(range(len(ls))) AS BIGINT) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
v AS (SELECT doc_id, i, line, w, lead(line) OVER p AS b, lead(w) OVER p AS wb, lead(line, 2) OVER p AS c FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, 1 AS n, [line] AS run FROM v WHERE w >= 50
  UNION ALL SELECT doc_id, i, 2, [line, b] FROM v WHERE b IS NOT NULL AND w + wb >= 50
  UNION ALL SELECT doc_id, i, 3, [line, b, c] FROM v WHERE c IS NOT NULL),
o AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM r),
z AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM o WHERE nth > 1),
k AS (SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE z.i IS NULL), '') AS text, count(*) AS n_lines, count(z.i) AS n_removed
  FROM l LEFT JOIN z ON z.doc_id = l.doc_id AND z.i = l.i GROUP BY l.doc_id)
SELECT documents.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed FROM documents LEFT JOIN k USING (doc_id)
"""
