"""Spelling variants grouped by an even-partition pigeonhole join (operator 11).

Words are near if one inserted, deleted or replaced code point parts them. Every word is cut in two even segments by its
length; one edit leaves one of them whole in the other word, at its place or shifted by one. So both segments of every word
are indexed under (length, place, segment), and words of equal or one-longer length probe the substrings where a whole
segment would lie: as many code points from the front, or from the end. What shares a key is a candidate, and one edit is
verified on the whole words.

A key that would make more than ``LIMIT`` candidates is not joined. What its words leave beside the shared segment is again
one edit apart, so that rest is cut in two even segments in its turn, and so on down to rests of one code point; then words
of one key differ in that place alone, and there are no more of them than letters. A pair follows the front segment wherever
that is whole and the end one elsewhere, so it is a candidate of one key only, and no link is lost.

Counts are combined before their exchange; keys are hashes, as words may be long; each round is written, so a lost executor
costs one of its stages. A word's form is its near word of largest count, if at least twice its own; as counts double along
forms, following them ends, and pointers are doubled, so few rounds reach the last one.

Defined results: a null text has no words; a null id deletes no letter; words too short or too rare are none; ties of the
count go to the smallest word in code-point order; repeated rows count each; without words the result is empty; other
columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import staged, table

RUN = "[A-Za-zÀ-ÿ]+"
LEAST = 5
RARE = 3
LIMIT = 1 << 14


def small(run: Column) -> Column:
    """A-Z in lower case, nothing else; ``lower`` may be used where no other capital stands."""
    return F.when(run.rlike("[À-Þ]"), F.translate(run, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(run))


def with_planted_slips(doc_id: Column, run: Column) -> Column:
    """The run less one code point where a hash of document and run says so."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(F.coalesce(h % 97 == 0, F.lit(False)), F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(words: DataFrame, least: int = LEAST, rare: int = RARE) -> DataFrame:
    """(word, n) of the column ``word``: those of ``least`` code points and ``rare`` occurrences or more."""
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= rare)


def _halved(entries: DataFrame) -> DataFrame:
    """The two keys of each entry. ``entries`` (word, n, long, key, m, lo, hi, not_here): the rest of ``word`` from lo to hi,
    ``m`` code points of which the shorter word of a pair has, and ``long`` of which it has more (null: it is that word)."""
    m, lo, hi, word = (F.col(c) for c in ("m", "lo", "hi", "word"))
    half = F.floor(m / 2).cast("int")
    part = lambda at, size: F.substring(word, at + 1, size)
    key = lambda place, segment: F.xxhash64("key", "m", F.lit(place), segment)
    front = F.struct(key(1, part(lo, half)).alias("key"), (m - half).alias("m"), (lo + half).alias("lo"), hi.alias("hi"), F.col("not_here"))
    back = F.struct(key(2, part(hi - (m - half), m - half)).alias("key"), half.alias("m"), lo.alias("lo"), (hi - (m - half)).alias("hi"), F.concat("not_here", F.array(F.struct(lo.alias("at"), half.alias("size")))).alias("not_here"))
    return entries.select("word", "n", "long", F.explode(F.array(front, back)).alias("x")).select("word", "n", "long", "x.*")


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, a_n, b, b_n): each pair of different words of (word, n) that one edit parts, once."""
    size = F.length("word")
    role = lambda long, m: F.struct(F.lit(long).cast("int").alias("long"), m.alias("m"))
    start = words.filter(size > 0).select("word", "n", F.explode(F.array(role(None, size), role(0, size), role(1, size - 1))).alias("r"))
    entries = start.select("word", "n", "r.long", F.lit(0).cast("long").alias("key"), "r.m", F.lit(0).alias("lo"), size.alias("hi"), F.array().cast("array<struct<at:int,size:int>>").alias("not_here"))
    pairs = None
    while True:
        entries = staged(_halved(entries), "segments")
        count = lambda c: F.count(F.when(c, 1))
        sizes = entries.groupBy("key", "m").agg(count(F.col("long").isNull()).alias("i"), count(F.col("long").isNotNull()).alias("p"))
        hot = staged(sizes.filter((F.col("i") * F.col("p") > limit) & (F.col("m") > 1)).select("key"), "hot")
        again = not hot.isEmpty()
        cold = entries.join(hot, "key", "left_anti") if again else entries
        index = cold.filter("long is null").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), "not_here")
        probe = cold.filter("long is not null").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), "long")
        part = lambda w, s: F.substring(F.col(w), s["at"] + 1, s["size"])
        once = ((F.col("long") == 1) | (F.col("a") < F.col("b"))) & ~F.exists("not_here", lambda s: part("a", s) == part("b", s))
        met = index.join(probe, "key").filter(once).filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")
        pairs = met if pairs is None else pairs.unionByName(met)
        if not again:
            return pairs
        entries = entries.join(hot, "key", "left_semi")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling."""
    jumps = staged(forms.select("word", F.col("form").alias("root")), "jumps")
    while True:
        far = jumps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        then = staged(jumps.join(far, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "jumps")
        if then.filter("_moved").isEmpty():
            return jumps
        jumps = then.select("word", "root")


def variant_groups(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of (word, n), whose words are distinct."""
    words = staged(words, "words")
    pairs = staged(near_pairs(words, limit), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n"))
    met = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    chosen = words.join(staged(met, "met"), "word", "left").withColumn("form_n", F.when(-F.col("best.minus") >= 2 * F.col("n"), -F.col("best.minus")))
    chosen = staged(chosen.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.near")).alias("form"), "form_n"), "forms")
    roots = _roots(chosen.filter("form is not null"))
    return chosen.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all ``documents``, some of which lose a letter first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).select("doc_id", small(F.col("run")).alias("run"))
    words = runs.select(with_planted_slips(F.col("doc_id"), F.col("run")).alias("word"))
    return variant_groups(count_words(words)).select("word", "form", "root", "n", "n_near", "form_n")


ORACLE = r"""
WITH RECURSIVE bits AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
found AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
coded AS (SELECT run, c, flatten([CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END
    FOR u IN [CAST(unicode(x) AS BIGINT) FOR x IN string_split(doc_id || ':' || run, '')]]) AS bytes FROM found),
hashed AS (SELECT run, c, xor(list_reduce(bytes, lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)]), 4294967295), 4294967295) AS h FROM coded, bits),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, v.word, v.n FROM cut JOIN v ON cut.less = v.word
  UNION SELECT v.word, cut.word, cut.n FROM cut JOIN v ON cut.less = v.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS nth FROM near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word AND nth = 1),
walk AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN f ON f.word = walk.next)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word AND walk.next IS NULL
"""
