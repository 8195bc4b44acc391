"""MinHash near-dedup with odd sketches (operator 8).

Texts become sets of hashed word shingles. Equal sets are one class from the start, so exact copies cost one row however
many there are. Bands of ``rows`` MinHash samples propose candidates. A second, finer sampling, the smallest hash in each
of ``BINS`` parts of the hash space, is folded into an odd sketch, a bitmap in which every (part, value) flips one bit:
samples that two sets share cancel in the XOR of their sketches, so its population count gives their similarity, the more
precisely the higher it is. Pairs whose count is more than ``SLACK`` standard errors beyond what the threshold gives are
dropped, the rest are confirmed on the full sets.

Groups stay linear as far as they can. In each of ``ROUNDS`` rounds every band bucket draws a leader by hash, each class
is compared with the leaders of its buckets by sketch, and only its best one is confirmed; classes that links join need
no further look at each other. What is left are buckets whose classes still lie in different components: those are
compared in blocks of ``BLOCK`` rows, pairs inside one component are skipped, and only pairs that pass the sketch leave
the task. Components come from alternating min-label steps, written and read each round.

A pair at the threshold 0.85 shares none of 20 bands of 4 with probability 4e-7; at 0.8, none of 28 with 4e-7.

Defined results: null or empty text, or one without words, has the empty set: alone in its component and kept; a text of
fewer words than a shingle has one shingle, the whole sequence; texts of one shingle set are one class; the document
kept is the smallest id; a null id is replaced by one near the largest long that its text names, so null ids come last;
rows of one id are one document, whose texts share a component; repeated rows are all returned; other columns pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.llm.common import ship, staged, table

BINS = 4096
SKETCH_LONGS = 32
SLACK = 4.5
ROUNDS = 3
BLOCK = 512
_LAST = 2**63 - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, computed once; emptied when it grows beyond a fixed size."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes. ``bytes.split()`` parts at exactly 0x20 and 0x09-0x0D."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    n = max(1, len(h) - size + 1)
    out = np.full(n, len(tokens) if len(tokens) < size else size, dtype=np.uint64)
    for k in range(min(size, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def seeds(samples: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.arange(1, 2 * samples + 1, dtype=np.uint64)
    m = _mix(x * np.uint64(0x9E3779B97F4A7C15))
    return m[:samples], m[samples:] | np.uint64(1)


def minhashes(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """(len(sets), samples) minima of non-empty sets, over all of them at a time."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    add, times = seeds(samples)
    out = np.empty((len(sets), samples), dtype=np.uint64)
    for i in range(samples):
        x = (flat ^ add[i]) * times[i]
        out[:, i] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
    return out


def odd_sketch(items: np.ndarray, bins: int = BINS, longs: int = SKETCH_LONGS) -> np.ndarray:
    """The bitmap of a sorted set: the first hash of each of ``bins`` equal ranges flips a bit."""
    part = items >> np.uint64(64 - bins.bit_length() + 1)
    first = items[np.concatenate([[True], part[1:] != part[:-1]])]
    at = (_mix(first) % np.uint64(64 * longs)).astype(np.int64)
    bits = (np.bincount(at, minlength=64 * longs) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def most_bits(n, similarity: float, exp=np.exp, sqrt=np.sqrt, larger=np.maximum, slack: float = SLACK):
    """The population count up to which a pair whose larger set has ``n`` items may still have ``similarity``.

    Of the parts that the union fills, 1 - J hold unlike samples; each flips one bit, and a second where both sets have
    a sample. The sampling error shrinks as the parts come to hold all of the union. Mean and variance of the count for
    so many flips are exact. ``n`` is a number, an array or, with Spark's functions, a column.
    """
    m, j = 64.0 * SKETCH_LONGS, similarity
    union = n / j
    parts = BINS * (1.0 - exp(-union / BINS)) + 2.0
    both = 1.0 - exp(-n / float(BINS))
    unlike = parts * (1.0 - j)
    flips = unlike * (1.0 + both)
    spread = (1.0 + both) * (1.0 + both) * unlike * j * larger(1.0 - parts / union, union * 0.0) + unlike * both * (1.0 - both)
    a, b = exp(flips * math.log(1 - 2 / m)), exp(flips * math.log(1 - 4 / m))
    noise = larger((m * (1.0 - a * a) + m * (m - 1.0) * (b - a * a)) / 4.0, a * 0.0)
    return m / 2 * (1.0 - a) + slack * sqrt(a * a * spread + noise) + 1.0


def _digest(s: np.ndarray) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(s.tobytes())


def _signed(size: int, bands: int, rows: int):
    samples = bands * rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for f in frames:
            keys, texts = f["k"].to_numpy(), f["text"]
            at = 0
            while at < len(f):
                sets, held, n = [], [], 0
                while at < len(f) and n < 300_000:  # so many hashes at a time bound the memory, one text at least
                    s = shingle_set(texts.iloc[at], size, words)
                    sets.append(s)
                    held.append(at)
                    n += len(s)
                    at += 1
                full = [s for s in sets if len(s)]
                m = minhashes(full, samples) if full else np.zeros((0, samples), dtype=np.uint64)
                sk = [odd_sketch(x) for x in full]
                band = np.zeros((len(m), bands), dtype=np.uint64)
                for b in range(bands):
                    x = np.full(len(m), b + 1, dtype=np.uint64)
                    for r in range(rows):
                        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + m[:, b * rows + r])
                    band[:, b] = x
                it = iter(range(len(m)))
                order = [next(it) if len(s) else -1 for s in sets]
                yield pd.DataFrame({
                    "k": keys[held],
                    "n": np.array([len(s) for s in sets], dtype=np.int64),
                    "digest": [_digest(s) if len(s) else None for s in sets],
                    "sketch": [sk[i] if i >= 0 else None for i in order],
                    "band": [band[i].view(np.int64) if i >= 0 else None for i in order],
                })

    return run


def _near(a: np.ndarray, b: np.ndarray, na, nb, similarity: float) -> np.ndarray:
    # of signed numbers, bitwise_count would count the absolute value
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64) <= most_bits(np.maximum(na, nb), similarity)


def _block_pairs(similarity: float):
    """Pairs of different components with sketches near enough, over rows sorted by block pair of a bucket; each pair only
    in the first band that it shares."""
    def group(c, size, label, side, sketch, band, b) -> list[tuple[np.ndarray, np.ndarray]]:
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        out = []
        if len(left) == 0 or len(right) == 0:
            return out
        names, count = np.unique(label, return_counts=True)
        large = names[np.argmax(count)]
        # Both members of a pair lie in the largest component or one of them does not: it suffices to start from that one.
        for i in np.flatnonzero(label != large):
            for mine, others in ((side[i] != 1, right), (side[i] != 0, left)):
                if not mine:
                    continue
                js = others[(label[others] != label[i]) & ((label[others] == large) | (others > i))]
                if len(js):
                    js = js[_near(sketch[i], sketch[js], size[i], size[js], similarity)]
                    js = js[(band[js, :b] != band[i, :b]).all(axis=1)]  # else an earlier band has told this pair
                    out.append((np.full(len(js), c[i]), c[js]))
                if side[i] == 2:
                    break
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _whole_groups(frames):
            key = f[["b", "h", "p", "q"]].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
            sizes = np.diff(np.concatenate([starts, [len(f)]]))
            c, size, label, side = (f[x].to_numpy() for x in ("c", "size", "label", "side"))
            sketch, band = np.stack(f["sketch"].to_numpy()), np.stack(f["band"].to_numpy())
            two = starts[sizes == 2]
            two = two[label[two] != label[two + 1]]
            two = two[_near(sketch[two], sketch[two + 1], size[two], size[two + 1], similarity)] if len(two) else two
            before = np.arange(band.shape[1]) < key[two, 0][:, None]
            ok = two[~((band[two] == band[two + 1]) & before).any(axis=1)]
            found = [(c[ok], c[ok + 1])]
            for at, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                x = slice(at, at + n)
                found += group(c[x], size[x], label[x], side[x], sketch[x], band[x], key[at, 0])
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return run


def _whole_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Regroup sorted batches so that no (b, h, p, q) is cut; the carry is at most one block pair."""
    rest = None
    for f in frames:
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        key = f[["b", "h", "p", "q"]].to_numpy()
        same = (key == key[-1]).all(axis=1)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        rest = f.iloc[cut:].reset_index(drop=True)
        if cut:
            yield f.iloc[:cut].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _sets(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordHashes()
        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                yield pd.DataFrame({"c": part["c"].to_numpy(), "items": [shingle_set(t, size, words).view(np.int64) for t in part["text"]]})

    return run


ship(__name__)


def _apart(a: Column, b: Column) -> Column:
    out = F.lit(0)
    for i in range(SKETCH_LONGS):
        out = out + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return out


def _stars(e: DataFrame) -> bool:
    """Whether every node above another has one edge down, to a node that has none: nothing is left to do."""
    ends = e.select(F.col("u").alias("c"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select(F.col("v").alias("c"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("c").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or down = 1 and up = 1").isEmpty()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(c, label): the smallest node that each node reaches. ``edges`` (a, b); nodes without an edge are their own label.

    Rounds of large-star and small-star: every round ties the neighbours of a node to their smallest one, first those
    above the node, then those below it. The edges never grow in number, until only stars are left.
    """
    e = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "large")
        down = staged(large.groupBy("u").agg(F.min("v").alias("m")), "down")
        small = large.join(down, "u").select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).distinct()
        e = staged(small, "small")
    return nodes.join(e.select(F.col("u").alias("c"), F.col("v").alias("to")), "c", "left").select("c", F.coalesce("to", "c").alias("label"))


def _confirmed(pairs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are ``similarity`` alike. Integer arithmetic, hundredths."""
    j = staged(pairs, "pairs").join(items.select(F.col("c").alias("a"), F.col("items").alias("x")), "a").join(items.select(F.col("c").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    counted = j.select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("t"))
    return staged(counted.filter(F.col("i") * 100 >= (F.col("t") - F.col("i")) * round(similarity * 100)).select("a", "b"), "links")


def _united(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (c, label) after ``links`` (a, b) between classes have joined components."""
    of = lambda end: label.select(F.col("c").alias(end), F.col("label").alias(f"l{end}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b")
    between = staged(between, "between")
    if between.isEmpty():
        return label
    ends = between.select(F.col("a").alias("c")).union(between.select(F.col("b").alias("c"))).distinct()
    merged = components(ends, between).select(F.col("c").alias("label"), F.col("label").alias("to"))
    return staged(label.join(merged, "label", "left").select("c", F.coalesce("to", "label").alias("label")), "label")


def _key(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST) - F.pmod(F.xxhash64(text_col), F.lit(2**40)))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bands: int = 28, rows: int = 4) -> DataFrame:
    """(k, n_shingles, component_id, kept): a row for each row of ``docs``, k being its id."""
    texts = docs.select(_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    schema = "k long, n long, digest string, sketch array<long>, band array<long>"
    signed = staged(texts.mapInPandas(_signed(size, bands, rows), schema), "signed")
    # A class is named by its smallest id; the text of that id is the one that is hashed again to confirm.
    classes = staged(signed.filter("digest is not null").groupBy("digest").agg(F.min("k").alias("c")), "classes")
    heads = staged(signed.join(classes, "digest").filter("k = c").select("c", "digest", F.col("n").alias("size"), "sketch", "band").dropDuplicates(["c", "digest"]), "heads")
    banded = heads.select("c", F.posexplode("band").alias("b", "h"))
    shared = staged(banded.groupBy("b", "h").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = staged(banded.join(shared, ["b", "h"]).select("b", "h", "n", "c").distinct(), "members")
    used = members.select("c").distinct()
    # The texts are sorted into the join at any size: a broadcast of ids that grow with the input is no way out.
    own = texts.select(F.col("k").alias("c"), "text").hint("merge").join(used, "c", "left_semi")
    own = own.groupBy("c", F.xxhash64("text").alias("th")).agg(F.first("text").alias("text")).select("c", "text")
    items = staged(own.mapInPandas(_sets(size), "c long, items array<long>"), "items")
    sketches = staged(heads.select("c", "size", "sketch", "band").join(used, "c", "left_semi"), "sketches")
    as_ = lambda end: sketches.select(F.col("c").alias(end), F.col("size").alias(f"s{end}"), F.col("sketch").alias(f"k{end}"))
    label = staged(used.select("c", F.col("c").alias("label")), "label")
    left = members
    for turn in range(ROUNDS):
        # Each bucket draws a leader by hash; each class confirms its nearest leader.
        drawn = F.struct(F.xxhash64("c", "b", F.lit(turn)).alias("o"), F.col("c").alias("l"))
        leaders = staged(left.groupBy("b", "h").agg(F.min(drawn)["l"].alias("l")), "leaders")
        met = left.join(leaders, ["b", "h"]).filter("c <> l").select("c", "l").distinct()
        if turn:
            met = met.join(label, "c").join(label.select(F.col("c").alias("l"), F.col("label").alias("ll")), "l").filter("label <> ll").select("c", "l")
        near = met.join(as_("c"), "c").join(as_("l"), "l").select("c", "l", _apart(F.col("kc"), F.col("kl")).alias("d"), F.greatest("sc", "sl").cast("double").alias("n"))
        near = near.filter(F.col("d") <= most_bits(F.col("n"), similarity, F.exp, F.sqrt, F.greatest))
        best = near.groupBy("c").agg(F.min(F.struct("d", "l"))["l"].alias("l")).select(F.least("c", "l").alias("a"), F.greatest("c", "l").alias("b")).distinct()
        label = _united(label, _confirmed(best, items, similarity))
        tagged = left.select("b", "h", "n", "c").join(label, "c")
        still = staged(tagged.groupBy("b", "h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("b", "h"), "still")
        left = staged(left.join(still, ["b", "h"], "left_semi"), "left")
    # Buckets that still hold more than one component: every pair that may be alike, in blocks.
    tagged = left.join(label, "c").join(sketches, "c").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("mine", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    # A row meets every block of its bucket, its own included: side 0 is the lower block, 1 the higher, 2 both.
    spread = tagged.select("b", "h", "c", "size", "sketch", "band", "label", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("b", "h", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"), "c", "size", "sketch", "band", "label")
    sorted_ = spread.repartition("b", "h", "p", "q").sortWithinPartitions("b", "h", "p", "q")
    more = sorted_.mapInPandas(_block_pairs(similarity), "a long, b long").distinct()
    label = _united(label, _confirmed(more, items, similarity))
    named = classes.join(label, "c", "left").select("digest", F.coalesce("label", "c").alias("label"))
    named = staged(named.select("digest", "label"), "named")
    out = signed.select("k", "n", "digest").join(named, "digest", "left")
    comp = F.coalesce("label", "k")
    return out.select("k", F.col("n").alias("n_shingles"), comp.alias("component_id"), (comp == F.col("k")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns."""
    keep = staged(near_groups(docs, id_col, text_col, **kw).filter("kept").select("k").distinct(), "keep")
    rows = docs.select(F.struct("*").alias("row")).withColumn("k", _key(f"row.{id_col}", f"row.{text_col}"))
    return rows.hint("merge").join(keep, "k", "left_semi").select("row.*")


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` on distinct three-word shingles, at 0.85."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs, size=3, similarity=0.85, bands=20, rows=4).select(F.col("k").alias("doc_id"), "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END)) AS sh FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 85 * (x.n + y.n - p.i)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, x.b FROM r JOIN both_ways x ON r.b = x.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
