"""Question-answer records: dedup, gates, fuzzy lookup, ChatML, splits."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.frames import materialise, top_n
from lodestream.functions import columns as C
import sys

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shortest_answers(qa: DataFrame, keys: list[str], least: int = 40) -> DataFrame:
    """Per question the first record, or the shortest later one that is strictly shorter than it and long enough; the
    first on ties. ``pos`` orders the records."""
    size = F.length(F.trim(F.regexp_replace("answer", r"\s+", " ")))
    x = qa.withColumn("_len", size)
    g = x.groupBy(*keys).agg(F.min(F.struct("pos", "_len", *[c for c in x.columns if c not in (*keys, "pos", "_len")])).alias("f"), F.min(F.when(F.col("_len") >= least, F.struct("_len", "pos", *[c for c in x.columns if c not in (*keys, "pos", "_len")]))).alias("s"))
    better = F.col("s").isNotNull() & (F.col("s._len") < F.col("f._len"))
    rest = [c for c in qa.columns if c not in keys]
    return g.select(*keys, *[F.when(better, F.col(f"s.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in rest])


def chatml(qa: DataFrame, system: str, metadata: list[str]) -> DataFrame:
    msg = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return qa.select("id", F.to_json(F.struct(F.array(msg("system", F.lit(system)), msg("user", F.col("question")), msg("assistant", F.col("answer"))).alias("messages"), F.struct(*metadata).alias("metadata"))).alias("record"))


def train_eval_split(df: DataFrame, key: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """Adds ``split``: exactly max(1, int(share * n)) rows are "eval", those of the smallest hash of the key.

    The hashes are cut into 65,536 ranges, whose counts tell in which one the last of these rows lies; only the rows of
    that range are ranked.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 12), 16, 10).cast("bigint")
    d = materialise(df.withColumn("_h", h).withColumn("_r", F.shiftright("_h", 32).cast("int")).withColumn("_t", F.monotonically_increasing_id()))
    counts = d.groupBy("_r").agg(F.count("*").alias("n")).orderBy("_r").collect()
    left = max(1, int(share * sum(r["n"] for r in counts)))
    for r in counts:
        if r["n"] >= left:
            break
        left -= r["n"]
    if not counts:
        return df.withColumn("split", F.lit("train"))
    border = d.filter(F.col("_r") == r["_r"]).withColumn("_n", F.row_number().over(Window.orderBy("_h", key, "_t"))).filter(F.col("_n") <= left).select("_t", F.lit(1).alias("_in"))
    j = d.join(border, "_t", "left")
    return j.withColumn("split", F.when((F.col("_r") < r["_r"]) | F.col("_in").isNotNull(), "eval").otherwise("train")).drop("_h", "_r", "_t", "_in")


def _flags(words: Iterable[str], texts: pd.Series) -> np.ndarray:
    return np.array([any(w in t for w in words) for t in texts.str.lower()], dtype=bool)


def _common(a: str, b: str) -> int:
    """The length of the longest common subsequence: one bit a character of ``a``."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole = v = (1 << len(a)) - 1
    for x in b:
        if m := at.get(x):
            u = v & m
            v = (v + u | v - u) & whole
    return len(a) - v.bit_count()


def _longest(a: str, b: str) -> tuple[int, int, int]:
    """The first longest common block of two texts (start in either, length), as ``find_longest_match`` tells it where no
    character of ``b`` is too common: by sets of the stretches of one length, which is doubled and halved."""
    at, size, over, n = 0, 0, min(len(a), len(b)) + 1, 6
    while over - size > 1:
        n = min(n, over - 1)
        have = {b[j : j + n] for j in range(len(b) - n + 1)}
        i = next((i for i in range(at, len(a) - n + 1) if a[i : i + n] in have), None)
        if i is None:
            over = n
        else:
            at, size = i, n  # a longer block starts no earlier
        n = (size + over) // 2 if over <= 2 * size + 1 or i is None else 2 * size
    return at, b.find(a[at : at + size]), size


def _ratio(m: SequenceMatcher, least: float) -> float | None:
    """``m.ratio()``, or None as soon as it can't reach ``least``: found so far and the common subsequences of all ranges
    left, as the blocks of a range are one."""
    size = len(m.a) + len(m.b)
    need, found, left = least * size / 2 - 1e-6, 0, [(0, len(m.a), 0, len(m.b), min(len(m.a), len(m.b)))]
    room = left[0][4]
    while left:
        a, az, b, bz, most = left.pop()
        room -= most
        if m.bpopular:
            i, j, n = m.find_longest_match(a, az, b, bz)
        else:
            i, j, n = _longest(m.a[a:az], m.b[b:bz])
            i, j = a + i, b + j
        if n:
            found += n
            sides = [(*r, min(r[1] - r[0], r[3] - r[2])) for r in ((a, i, b, j), (i + n, az, j + n, bz)) if r[0] < r[1] and r[2] < r[3]]
            room += sum(r[4] for r in sides)
            for *r, most in sorted(sides, key=lambda r: -r[4]):  # the larger first, often it is enough
                if found + room < need:
                    return None
                less = _common(m.a[r[0] : r[1]], m.b[r[2] : r[3]])
                room -= most - less
                if less:
                    left.append((*r, less))
        if found + room < need:
            return None
    return 2.0 * found / size if size else 1.0


class _Sequences:
    """The longest common subsequences of a text with all others at once: one bit a character, a gap bit after each text."""

    def __init__(self, texts: list[str]):
        ends = np.cumsum([len(t) + 1 for t in texts])
        letters = np.array([ord(x) for t in texts for x in (*t, "\0")], dtype=np.uint32)
        self.starts, self.sizes, self.bits = ends - [len(t) + 1 for t in texts], np.array([len(t) for t in texts]), len(letters)
        gaps = np.zeros(len(letters), dtype=bool)
        gaps[ends - 1] = True
        pack = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
        self.all, self.of = pack(~gaps), {chr(x): pack((letters == x) & ~gaps) for x in np.unique(letters)}

    def common(self, text: str) -> np.ndarray:
        v = self.all
        for x in text:
            if m := self.of.get(x):
                u = v & m
                v = ((v + u) | (v ^ u)) & self.all
        ones = np.unpackbits(np.frombuffer(v.to_bytes(self.bits // 8 + 1, "little"), np.uint8), bitorder="little")[: self.bits]
        return self.sizes - np.add.reduceat(ones.astype(np.int64), self.starts)


def _grams(texts: Iterable[str], known: dict[str, int], n: int = 3) -> np.ndarray:
    """(grams, texts): how often each text has each of the known grams."""
    out = np.zeros((len(known), len(texts)), np.int32)
    for i, t in enumerate(texts):
        for g, many in Counter(t[j : j + n] for j in range(len(t) - n + 1)).items():
            if g in known:
                out[known[g], i] = many
    return out


def _counted(a: Iterable, b: Iterable) -> tuple[np.ndarray, np.ndarray]:
    """How often each list of either side holds each of the values that both sides have."""
    sizes = [np.array([len(x) for x in xs], dtype=np.int64) for xs in (a, b)]
    values = np.array([v for xs in (a, b) for x in xs for v in x], dtype=object)
    codes, known = pd.factorize(values)
    codes = np.split(codes, [sizes[0].sum()])
    both = np.isin(np.arange(len(known)), codes[0]) & np.isin(np.arange(len(known)), codes[1])
    place, out = np.cumsum(both) - 1, []
    for n, code in zip(sizes, codes, strict=True):
        row = np.repeat(np.arange(len(n)), n)
        at = both[code]
        out.append(np.bincount(row[at] * both.sum() + place[code[at]], minlength=len(n) * both.sum()).reshape(len(n), both.sum()).astype(np.int32))
    return out[0], out[1]


def _best(q: pd.DataFrame, c: pd.DataFrame, k: int, accept: float, about: dict[str, list[str]], lot_words: list[str], first: bool = False, alike: bool = True) -> pd.DataFrame:
    """The best ``k`` of one ticker's questions for each query, at ``accept`` or the query's ``floor``. The word lists come in,
    so that workers need not import them. Questions come by an upper bound of their score, and none is left out whose bound reaches the k-th score so far. ``first``: only the k
    first by that bound, ``alike``: of those that share half of the words.

    Two bounds of the matched characters count: the common ones, with their repeats; and, as a block of n characters holds
    n - 2 common triples, the common triples and two a block. In texts of 200 characters or more the ratio finds a block
    only around a character that is rare in the known question, but for one at the start of both, so that there are no
    more blocks than common rare characters and one.
    """
    if not len(q) or not len(c):
        return pd.DataFrame({"query_id": [], "item": [], "score": []}).astype({"query_id": "int64", "item": "int64", "score": "float64"})
    c = c.sort_values("item", ignore_index=True)
    # Words and letters count where both sides have them: no others are shared.
    q_words, c_words = _counted(q["qt"], c["ct"])
    shared = q_words.astype(np.float64) @ c_words.T.astype(np.float64)
    union = q["qt"].map(len).to_numpy()[:, None] + c["ct"].map(len).to_numpy()[None, :] - shared
    jaccard = shared / np.maximum(union, 1)
    if first and alike and not (2 * jaccard >= 1).any():
        return pd.DataFrame({"query_id": [], "item": [], "score": []}).astype({"query_id": "int64", "item": "int64", "score": "float64"})
    q_letters, c_letters = _counted(q["qk"].map(list), c["ck"].map(list))
    tag, answer, size = c["tag"].str.lower(), c["answer"], c["ck"].map(len).to_numpy()
    has = {kind: _flags(ws, c["ck"]) for kind, ws in about.items()}
    risk_tag, fee_tag, dividend_tag = (_flags([w], tag) for w in ("risk", "fees_charges", "dividend"))
    lots, old = _flags(lot_words, answer), _flags(["authorized under section 104"], answer)
    short = np.where(answer.str.strip().str.len() < 25, 0.08, 0.0)
    spoken = c["language"].to_numpy()
    rare = np.where(c_letters <= size[:, None] // 100 + 1, c_letters, 0)
    items, keys, out = c["item"].to_numpy(), c["ck"].tolist(), []
    made: dict[int, SequenceMatcher] = {}
    low = size < 200
    # What only some queries need is made when the first of them does.
    triples: dict[str, int] = {}
    c_triples = lines = None
    fitting: dict[tuple | None, np.ndarray] = {}
    floors = q["floor"] if "floor" in q else [None] * len(q)
    for i, (query, key, pool, kinds, floor) in enumerate(zip(q["query_id"], q["qk"], q["pool"], q["kinds"], floors, strict=True)):
        risk, fee, dividend, tracking = kinds
        pool = None if pool is None else tuple(pool)
        if pool not in fitting:
            fitting[pool] = np.ones(len(c), dtype=bool) if pool is None else np.isin(spoken, list(pool))
        fits = fitting[pool]
        if first and alike:
            fits = fits & (2 * jaccard[i] >= 1)
            if not fits.any():
                continue
        rest = 0.3 * jaccard[i] - short
        if risk:
            fits = fits & (has["risk"] | risk_tag)
            rest = rest + 0.14 * has["risk"] + 0.14 * risk_tag - 0.2 * old
        if fee:
            fits = fits & (has["fee"] | fee_tag)
            rest = rest + 0.16 - 0.45 * lots
        if dividend:
            fits = fits & (has["dividend"] | dividend_tag)
            rest = rest + 0.14
        if tracking:
            rest = rest + 0.12 * has["tracking"]
        least = accept if floor is None or floor != floor else max(accept, floor)
        # One bound after the other, each for those that the one before leaves: lengths, letters, triples, subsequences.
        reach = lambda js, common: 0.7 * 2 * common / (len(key) + size[js]) + rest[js]  # noqa: B023, E731
        js = np.flatnonzero(fits)
        js = js[reach(js, np.minimum(size[js], len(key))) >= least - 1e-9]
        if not len(js):
            continue
        common = np.minimum(c_letters[js], q_letters[i]).sum(1)
        some = reach(js, common) >= least - 1e-9
        js, common = js[some], common[some]
        long = ~low[js]
        if long.any():
            if c_triples is None:
                triples = {g: n for n, g in enumerate(sorted({t[j : j + 3] for t in q["qk"] for j in range(len(t) - 2)}))}
                c_triples, long_of = _grams([keys[j] for j in np.flatnonzero(~low)], triples), np.cumsum(~low) - 1
            at = Counter(triples[key[j : j + 3]] for j in range(len(key) - 2))
            rows, many = np.array([*at.keys()], dtype=np.int64), np.array([*at.values()], dtype=np.int32)
            blocks = np.minimum(rare[js[long]], q_letters[i]).sum(1) + 1
            common[long] = np.minimum(common[long], np.minimum(c_triples[rows], many[:, None]).sum(0)[long_of[js[long]]] + 2 * blocks)
        bound = reach(js, common)
        if not first and (low[js] & (bound >= least - 1e-9)).sum() > 8:
            # Matched blocks are in order on both sides, so that they are a common subsequence.
            if lines is None:
                lines, line_of = _Sequences([keys[j] for j in np.flatnonzero(low)]), np.cumsum(low) - 1
            bound[~long] = np.minimum(bound[~long], reach(js[~long], lines.common(key)[line_of[js[~long]]]))
        best: list[tuple[float, int]] = []
        order = np.argsort(-bound, kind="stable")
        for n in order[:k] if first else order:
            j, need = js[n], max(least, best[-1][0]) if len(best) == k else least
            if bound[n] < need - 1e-9:
                break
            if j not in made:
                made[j] = SequenceMatcher(None, "", keys[j])
            made[j].set_seq1(key)
            ratio = _ratio(made[j], (need - 1e-9 - rest[j]) / 0.7)
            score = None if ratio is None else 0.7 * ratio + rest[j]
            if score is not None and score >= accept:
                best = sorted([*best, (score, items[j])], key=lambda x: (-x[0], x[1]))[:k]
        out += [(query, item, score) for score, item in best]
    return pd.DataFrame(out, columns=["query_id", "item", "score"]).astype({"query_id": "int64", "item": "int64", "score": "float64"})


def fuzzy_lookup(queries: DataFrame, corpus: DataFrame, k: int = 1, accept: float = 0.38, block: int = 1000) -> DataFrame:
    """Best answers of each query among the records of its ticker, by 0.7 * Ratcliff-Obershelp ratio + 0.3 * token Jaccard
    with gates and bonuses by intent, at ``accept`` or more.

    ``queries`` (query_id, ticker, text), ``corpus`` (item, ticker, question, answer, language, tag). Risk, fee and dividend
    queries look only at records of their kind; languages outside the query's pool count only where the ticker has no record
    of the pool. Questions for a recommendation are not looked up, they are left to the synthesis. Every query meets every
    record of its ticker, in blocks of about ``block`` rows of either, which change no result; the ratio has no built-in and
    runs over Arrow batches. An empty question is none; null tickers meet nothing.
    """
    asks = lambda c: F.array(*[C.contains_any(c, C.fixed.INTENTS[x]) for x in ("risk", "fee", "dividend", "tracking")]).alias("kinds")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pools = {"zh": ["zh", "zh-HK", "en"], "en": ["en", "zh-HK"]}
    q = queries.select("query_id", "ticker", C.match_key(text("text")).alias("qk")).filter("qk <> ''").filter(~C.contains_any(F.col("qk"), C.fixed.INTENTS["recommendation"]))
    q = q.select("query_id", "ticker", "qk", C.tokens(F.col("qk")).alias("qt"), C.language(F.col("qk")).alias("_spoken"), asks(F.col("qk")))
    c = corpus.select("item", "ticker", C.match_key(text("question")).alias("ck"), text("answer").alias("answer"), text("language").alias("language"), text("tag").alias("tag"))
    # Whether a ticker has records of a pool is settled over all of them, before any block is dealt.
    has = materialise(c.groupBy("ticker").agg(*[F.max(F.col("language").isin(ls).cast("int")).alias(f"_{z}") for z, ls in pools.items()]))
    pool = F.coalesce(*[F.when((F.col("_spoken") == z) & (F.col(f"_{z}") == 1), F.array(*map(F.lit, ls))) for z, ls in pools.items()])
    q = q.join(has, "ticker").withColumn("pool", pool).drop("_spoken", *[f"_{z}" for z in pools])
    c = c.filter("ck <> ''").withColumn("ct", C.tokens(F.col("ck")))
    # As many blocks a ticker as its own rows fill.
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    counts = lambda df, n: materialise(df.groupBy("ticker").agg(F.ceil(F.count("*") / block).alias(n)))
    nq, nc = counts(q, "nq"), counts(c, "nc")
    q = q.join(nq, "ticker").join(nc, "ticker").select("*", part("query_id", "nq").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("nc").cast("int") - 1)).alias("cb")).drop("nq", "nc")
    c = c.join(nq, "ticker").join(nc, "ticker").select("*", part("item", "nc").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("nq").cast("int") - 1)).alias("qb")).drop("nq", "nc")
    key = ["ticker", "qb", "cb"]
    about, lots = dict(C.fixed.LOOKUP_WORDS), list(C.fixed.LOT_WORDS)
    q, c, schema = materialise(q), materialise(c), "query_id long, item long, score double"
    # A question that is nearly the query's own lies in one block; what it scores spares the query most pairs of all others.
    # Without such a one the first by bound of every block are asked.
    # Blocks are few bytes and much work, so that Spark may not gather them into fewer tasks.
    dealt = lambda df: df.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, *key).groupBy(*key)
    asked = lambda *how: lambda x, y: _best(x, y, k, accept, about, lots, *how)
    floors = None
    for alike in (True, False):
        some = q if floors is None else q.join(floors, "query_id", "left_anti")
        near = dealt(some).cogroup(dealt(c)).applyInPandas(asked(True, alike), schema)
        kth = materialise(top_n(near, ["query_id"], k, F.col("score").desc(), F.col("item")).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor")))
        floors = kth if floors is None else floors.unionByName(kth)
    q = q.join(floors, "query_id", "left")
    r = dealt(q).cogroup(dealt(c)).applyInPandas(asked(), schema)
    return top_n(r, ["query_id"], k, F.col("score").desc(), F.col("item"))


def topic_rows(sentences: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """(key, topic, rank, pos, text): the first ``limit`` sentences of each topic's pattern, any case."""
    topics = F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), F.lit(t)) for t, p in C.fixed.TOPIC_PATTERNS.items()])
    return top_n(sentences.select(key, "pos", "text", F.explode(F.array_compact(topics)).alias("topic")), [key, "topic"], limit, F.col("pos"))


def topic_answers(sentences: DataFrame, key: str, limit: int = 8, most_chars: int = 900, seed: int = 42) -> DataFrame:
    """(key, topic, n, question, answer, pos): for each question of a topic two to four of the topic's first ``limit``
    sentences. A hash of seed, key and question tells how many, a hash of these and the sentence which and in what order, so
    that equal inputs give equal answers wherever they run."""
    have = topic_rows(sentences, key, limit).groupBy(key, "topic").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "text"))).alias("rows"))
    table = F.create_map(*[x for t, qs in C.fixed.TOPIC_QUESTIONS.items() for x in (F.lit(t), F.array(*[F.lit(q) for q in qs]))])
    d = have.select(key, "topic", "rows", F.posexplode(table[F.col("topic")]).alias("n", "ask"))
    d = d.withColumn("question", F.replace("ask", F.lit("{}"), F.col(key).cast("string"))).withColumn("_h", F.concat_ws(":", F.lit(str(seed)), "question"))
    take = F.least(F.size("rows"), 2 + F.conv(F.substring(F.md5("_h"), 1, 4), 16, 10).cast("int") % 3)
    dealt = F.array_sort(F.transform("rows", lambda r: F.struct(F.md5(F.concat_ws(":", F.col("_h"), r["text"])).alias("h"), r["text"].alias("text"))))
    answer = C.compact_answer(F.array_join(F.transform(F.slice(dealt, F.lit(1), take), lambda x: x["text"]), " "), most_chars)
    return d.select(key, "topic", "n", "question", answer.alias("answer"), F.get("rows", F.lit(0))["pos"].alias("pos"))


def risk_bullets(scored: DataFrame, k: int = 3, top: int = 8, least: float = 0.30) -> DataFrame:
    """(query_id, bullet, item, text): up to ``k`` different answers about risks among the ``top`` best of each query.

    ``scored`` (query_id, item, score, question, answer, tag). Answers below ``least``, not about risks, empty or with legal
    fragments go; of equal ones (in normal form) the better stays."""
    first = top_n(scored, ["query_id"], top, F.col("score").desc(), F.col("item")).filter(F.col("score") >= least)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    about = F.lower(text("tag")).contains("risk") | C.contains_any(text("question"), C.fixed.LOOKUP_WORDS["risk"])
    said = first.filter(about & ~C.contains_any(text("answer"), C.fixed.LEGAL_FRAGMENTS)).select("query_id", "item", "rank", C.summary_sentence(text("answer")).alias("text"))
    one = top_n(said.filter("text <> ''").withColumn("norm", C.normalise_text(F.col("text"))), ["query_id", "norm"], 1, F.col("rank"), rank="_one")
    return top_n(one, ["query_id"], k, F.col("rank"), rank="bullet").select("query_id", "bullet", "item", "text")


def question_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, question, answer) of each user turn with the assistant turn right after it."""
    u = turns.filter("role = 'user'").select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("question"))
    a = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("pos"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "pos"])
