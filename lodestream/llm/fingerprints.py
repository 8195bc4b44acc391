"""Document fingerprints as threshold-scaled sketches (operator 9, native).

Every five-word shingle is hashed to the first 60 bits of its MD5, and the sketch retains each hash below a fixed fraction
of the hash space. Sketches of any two texts are then comparable and mergeable by union, also where one is a thousand times longer,
which a fixed-size sketch is not. So that short texts are not left with nothing, a sketch also retains its ``floor``
smallest hashes; it is complete up to the larger of the threshold and its own floor, and two sketches are compared only
up to where both are complete, so the estimates stay unbiased.

Defined results: a null text is empty and has an empty sketch; a text of fewer than five words has one shingle, the
whole sequence, and one of no words none; two empty sketches are alike (1.0), an empty and a filled one are not (0.0); equal texts have equal
fingerprints; null ids come last, in the order of a hash of their text; repeated rows are separate rows; an empty table
gives an empty one; other columns, whatever their names, pass ``with_next``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.llm.common import let, numbers, table

WORDS = 5
FRACTION = 1 / 16
FLOOR = 64
HEX = 15
RANGE_BYTES = 4_000_000
MOST_RANGES = 16_384
_HIGHEST = 16**HEX - 1


def _threshold(fraction: float) -> int:
    return int(fraction * 16**HEX)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all word shingles of a text, as hex digits, which sort like the numbers; joining skips the nulls beyond the
    end of a short text."""
    tokens = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    per = lambda ws: F.when(
        F.size(ws) > 0,
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - words, F.lit(0))), lambda i: F.substring(F.md5(F.concat_ws(" ", *[F.get(ws, i + k) for k in range(words)])), 1, HEX)),
    ).otherwise(F.array().cast("array<string>"))
    return let(tokens, per)


def sketch(text: Column, fraction: float = FRACTION, floor: int = FLOOR, words: int = WORDS) -> Column:
    """Sorted array of the retained hashes of ``text``."""

    return let(shingle_hashes(text, words), lambda hashes: _retain(hashes, fraction, floor))


def _retain(hashes: Column, fraction: float, floor: int) -> Column:
    below = F.array_distinct(F.filter(hashes, lambda h: h < F.lit(f"{_threshold(fraction):0{HEX}x}")))
    kept = let(below, lambda b: F.when(F.size(b) >= floor, F.sort_array(b)).otherwise(F.slice(F.sort_array(F.array_distinct(hashes)), 1, floor)))
    return F.transform(kept, lambda h: F.conv(h, 16, 10).cast("bigint"))


def _complete_to(s: Column, fraction: float, floor: int) -> Column:
    return F.when(F.size(s) < floor, F.lit(_HIGHEST)).otherwise(F.greatest(F.lit(_threshold(fraction) - 1), F.element_at(s, -1)))


def merge(a: Column, b: Column, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """Sketch of the union of two shingle sets, to be compared like any other."""
    both = F.transform(F.array_union(a, b), lambda h: F.lower(F.lpad(F.hex(h), HEX, "0")))
    return let(both, lambda hashes: _retain(hashes, fraction, floor))


def _counts(a: Column, b: Column, fraction: float, floor: int, to) -> Column:
    def body(x: Column) -> Column:
        p, q = F.filter(a, lambda h: h <= x), F.filter(b, lambda h: h <= x)
        return to(F.size(F.array_intersect(p, q)).cast("double"), F.size(p).cast("double"), F.size(q).cast("double"))

    return let(F.least(_complete_to(a, fraction, floor), _complete_to(b, fraction, floor)), body)


def likeness(a: Column, b: Column, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """Estimated Jaccard similarity of two texts from their sketches."""
    both = F.size(a) + F.size(b) == 0
    return F.when(both, F.lit(1.0)).otherwise(F.coalesce(_counts(a, b, fraction, floor, lambda i, p, q: F.try_divide(i, p + q - i)), F.lit(0.0)))


def containment(a: Column, b: Column, fraction: float = FRACTION, floor: int = FLOOR) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; meaningful at very unequal lengths."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.coalesce(_counts(a, b, fraction, floor, lambda i, p, q: F.try_divide(i, p)), F.lit(0.0)))


def as_string(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), HEX, "0"))), "")


def _below(cuts: Column, n: int, key: Column) -> Column:
    """How many of ``n`` sorted constants are below ``key``: binary search."""
    powers = numbers([1 << i for i in range(n.bit_length() - 1, -1, -1)], "int")
    reached = lambda at, s: at + s <= n
    return F.aggregate(powers, F.lit(0), lambda at, s: F.when(reached(at, s) & (F.get(cuts, at + s - 1) < key), at + s).otherwise(at))


def with_next(docs: DataFrame, cols: list[str], id_col: str = "doc_id", parts: int | None = None, ties: list[str] | None = None, derived: dict[str, Column] | None = None) -> DataFrame:
    """Each row with ``next_<col>`` of the row that follows in descending id order, cyclically. ``derived`` columns, over the
    fields of ``row``, are computed behind the exchange, once a row that is dealt, and are had of both rows.

    The ids are cut into ranges of about ``RANGE_BYTES`` (of which there are at most ``MOST_RANGES``; beyond, they grow, and
    sort with spilling) by an approximate quantile sketch, each range is ordered by itself, and the exchange deals ranges by
    their rows, not by a hash. The first row of a range is also dealt to the range before it, which makes the one row that
    crosses the border; the first row of all closes the ring. Cuts and heads are constants of the plan, one a range.
    """
    derived = derived or {}
    tie = F.xxhash64(*(ties or cols))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)) + F.pmod(tie, F.lit(2**40)))
    keyed = docs.select(key.alias("k"), tie.alias("tie"), F.struct("*").alias("row"))
    if parts is None:
        kind = dict(docs.dtypes)
        size = sum((F.coalesce(F.octet_length(c) if kind[c] == "string" else F.size(c) * 8 if kind[c].startswith("array") else F.lit(8), F.lit(0)) for c in cols), F.lit(0))
        parts = min(MOST_RANGES, max(2, (docs.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0) // RANGE_BYTES))
    cuts = keyed.agg(F.percentile_approx("k", numbers([i / parts for i in range(1, parts)]), max(10_000, 4 * parts)).alias("cuts")).first()["cuts"] if parts > 1 else []
    cuts = sorted(set(cuts or []))
    # Range 0 holds the largest ids.
    keyed = keyed.withColumn("place", (F.lit(len(cuts)) - (_below(numbers(cuts, "bigint"), len(cuts), F.col("k")) if cuts else F.lit(0))).cast("int"))
    heads = sorted(tuple(r) for r in keyed.groupBy("place").agg(F.max(F.struct("k", "tie")).alias("h")).select("place", "h.k", "h.tie").collect())
    if not heads:
        none = {c: F.col(c) for c in cols} | {c: F.lit(None).cast("array<bigint>") for c in derived}
        return docs.select("*", *[none[c].alias(c) for c in derived], *[v.alias(f"next_{c}") for c, v in none.items()])
    # Each head goes to the range before it; the first of all to the last range.
    goes = {p: (k, t, heads[i - 1][0]) for i, (p, k, t) in enumerate(heads)}
    of = lambda i, kind: F.get(numbers([goes.get(p, (0, 0, -1))[i] for p in range(len(cuts) + 1)], kind), F.col("place"))
    keyed = keyed.withColumn("extra", F.when((F.col("k") == of(0, "bigint")) & (F.col("tie") == of(1, "bigint")), of(2, "int")).otherwise(-1))
    here = F.array(F.struct(F.col("place").alias("at"), F.lit(0).alias("guest")))
    both = F.concat(here, F.array(F.struct(F.col("extra").alias("at"), F.lit(1).alias("guest"))))
    dealt = keyed.select("k", "tie", "row", F.explode(F.when(F.col("extra") < 0, here).otherwise(both)).alias("x"))
    dealt = dealt.select("k", "tie", "row", F.col("x.at").alias("at"), F.col("x.guest").alias("guest")).repartitionByRange("at")
    dealt = dealt.select("*", *[c.alias(f"_own_{i}") for i, c in enumerate(derived.values())])
    own = {c: F.col(f"row.`{c}`") for c in cols} | {c: F.col(f"_own_{i}") for i, c in enumerate(derived)}
    w = Window.partitionBy("at").orderBy(F.col("guest"), F.col("k").desc(), F.col("tie").desc())
    out = dealt.select("row", "guest", *[F.col(f"_own_{i}") for i in range(len(derived))], *[F.lead(F.struct(c.alias("v"))).over(w).alias(f"_next_{i}") for i, c in enumerate(own.values())])
    return out.filter("guest = 0").select("row.*", *[own[c].alias(c) for c in derived], *[F.coalesce(F.col(f"_next_{i}.v"), c).alias(f"next_{n}") for i, (n, c) in enumerate(own.items())])


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, ["text"], derived={"fp": sketch(F.col("row.text"))})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = paired.select(
        "doc_id", n.cast("long").alias("n_chars"), "fp", "next_fp",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
    )
    done = edited.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("efp"))
    return done.select(
        "doc_id", "n_chars", "edited_sha256",
        as_string(F.col("fp")).alias("fingerprint"),
        as_string(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        containment(F.col("fp"), F.col("efp")).alias("contained_in_edited"),
    )


#: The edited text takes the next document's beginning; ids are told apart as they are in the table.
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT doc_id, t, n, coalesce(lead(t) OVER o, first_value(t) OVER o) AS t2, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS id2 FROM d WINDOW o AS (ORDER BY doc_id DESC)),
x AS (SELECT doc_id, n, id2, t, left(t, CAST(n - n // 2 AS BIGINT)) || left(t2, CAST(n // 2 AS BIGINT)) AS ed FROM e),
u AS (SELECT doc_id, 0 AS side, regexp_extract_all(t, '[^ 	-
]+') AS w FROM x UNION ALL SELECT doc_id, 1, regexp_extract_all(ed, '[^ 	-
]+') FROM x),
h AS (SELECT doc_id, side, list_sort(list_distinct([CAST('0x' || substr(md5(array_to_string(w[i:i + {WORDS - 1}], ' ')), 1, {HEX}) AS BIGINT) FOR i IN range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - {WORDS - 1}, 1) + 1 END)])) AS h FROM u),
b AS (SELECT doc_id, side, h, [v FOR v IN h IF v < {_threshold(FRACTION)}] AS low FROM h),
s AS (SELECT doc_id, side, CASE WHEN len(low) >= {FLOOR} THEN low ELSE h[1:{FLOOR}] END AS s FROM b),
c AS (SELECT doc_id, side, s, CASE WHEN len(s) < {FLOOR} THEN {_HIGHEST} ELSE greatest({_threshold(FRACTION) - 1}, s[len(s)]) END AS upto FROM s),
p AS (SELECT x.doc_id, x.n, sha256(x.ed) AS sha, a.s AS a, b.s AS b, z.s AS z, least(a.upto, b.upto) AS ub, least(a.upto, z.upto) AS uz
  FROM x JOIN c a ON a.doc_id = x.doc_id AND a.side = 0 JOIN c b ON b.doc_id = x.doc_id AND b.side = 1 JOIN c z ON z.doc_id = x.id2 AND z.side = 0),
q AS (SELECT *, [v FOR v IN a IF v <= ub] AS a1, [v FOR v IN b IF v <= ub] AS b1, [v FOR v IN a IF v <= uz] AS a2, [v FOR v IN z IF v <= uz] AS z2 FROM p),
i AS (SELECT *, len(list_intersect(a1, b1)) AS n1, len(list_intersect(a2, z2)) AS n2 FROM q)
SELECT doc_id, n AS n_chars, sha AS edited_sha256,
  array_to_string([lpad(lower(to_hex(v)), {HEX}, '0') FOR v IN a], '') AS fingerprint, array_to_string([lpad(lower(to_hex(v)), {HEX}, '0') FOR v IN b], '') AS edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE coalesce(n1 / nullif(len(a1) + len(b1) - n1, 0), 0.0) END AS near_edited,
  CASE WHEN len(a) + len(z) = 0 THEN 1.0 ELSE coalesce(n2 / nullif(len(a2) + len(z2) - n2, 0), 0.0) END AS near_next,
  CASE WHEN len(a) = 0 THEN 1.0 ELSE coalesce(n1 / nullif(len(a1), 0), 0.0) END AS contained_in_edited
FROM i
"""
