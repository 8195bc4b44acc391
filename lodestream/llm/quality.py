"""Quality classifier with hierarchical empirical Bayes (operator 4).

Document evidence: words and word beginnings whose odds differ between the labelled classes, and shape features
(symbols, repetition, lengths), in two logistic regressions, for low quality and for toxicity. Word odds come from one
half of the labelled sample and the regressions from the other, so that the weights do not trust words by heart.

Sites: the mean document posterior of a host is shrunk toward the global mean, that of a path (host and section) toward
its host's, each by a Beta prior whose strength the grouped between-site variance gives (method of moments): sparse sites
stay near their parent, large ones speak for themselves. A document's own evidence is taken out of both means before they
are shrunk, so that it counts once; its log odds are then moved from the global prior to that of its path.

The labelled sample is bounded by ``SAMPLE`` labels (smallest hash of the id first; of several rows with one id, one
text), the vocabulary by ``VOCABULARY`` entries in ``RARE`` labelled texts or more; all are parameters. Everything else, the site statistics included, is over all documents.

Defined results: a null or empty text, or one without words, is rejected; null hosts and sections are a site of their
own (""); label rows with nulls are ignored, of several for one id the mean counts; without labels of both kinds a head
is off (nothing is rejected by it); equal rows are judged alike; an empty table gives an empty one; other columns pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import ship, staged, table

SAMPLE = 20_000
VOCABULARY = 20_000
RARE = 3
WORD = re.compile(r"[^\W_]+")
SYMBOLS = "*#$%&|~^=<>{}[]\\@"
FEATURES = 16


def pieces(words: set[str]) -> set[str]:
    """Words, and their first four and five letters under their own names."""
    return words | {"4:" + w[:4] for w in words if len(w) > 4} | {"5:" + w[:5] for w in words if len(w) > 5}


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, bad, toxic = Counter(), Counter(), Counter()

    def table() -> pd.DataFrame:
        return pd.DataFrame({"piece": list(n), "n": list(n.values()), "bad": [float(bad[k]) for k in n], "toxic": [float(toxic[k]) for k in n]})

    for f in frames:
        for text, b, t in zip(f["text"], f["bad"], f["toxic"], strict=True):
            for p in pieces(set(WORD.findall((text or "").lower()))):
                n[p] += 1
                bad[p] += b
                toxic[p] += t
            if len(n) > 500_000:
                yield table()
                n.clear(), bad.clear(), toxic.clear()
    if n:
        yield table()


def features(text: str | None, bad: dict[str, float], toxic: dict[str, float]) -> tuple[int, list[float]]:
    """Number of words, and the evidence of one whole text."""
    text = (text or "").lower()
    words = WORD.findall(text)
    n, size = len(words), max(1, len(text))
    have = pieces(set(words))
    out = []
    for odds in (bad, toxic):
        hits = sorted((odds[p] for p in odds.keys() & have), reverse=True)
        top = hits[:6]
        strong = sum(h > 2 for h in hits)
        out += [sum(top) / 6, top[0] if top else 0.0, np.log1p(strong), strong / (1 + len(have)) ** 0.5, min(0.0, sum(hits[-6:]) / 6)]
    marks = sum(map(text.count, SYMBOLS))
    distinct = len(set(words)) / max(1, n)
    spaces = text.count(" ") + text.count("\n")
    out += [np.log1p(n), marks / size, distinct, text.count("|") / (1 + spaces), sum(map(len, words)) / max(1, n), np.log1p(n) * distinct]
    return n, [float(x) for x in out]


def _evidence(bad: dict[str, float], toxic: dict[str, float]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [features(t, bad, toxic) for t in f["text"]]
            yield f.drop(columns="text").assign(n_words=np.array([n for n, _ in got], dtype=np.int64), x=[x for _, x in got])

    return run


ship(__name__)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and intercept on the raw features, by Newton's method on standardised ones."""
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / std, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / std, float(w[-1] - (w[:-1] * mean / std).sum())


def labelled_sample(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, bad, toxic, fold), at most ``sample`` rows, the same whatever the partitions."""
    one = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg((1 - F.avg("quality")).alias("bad"), F.avg("toxic").cast("double").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)))


def word_odds(counts: DataFrame, n: float, positive: float, kind: str, limit: int) -> dict[str, float]:
    """Log odds of the pieces that tell the classes apart best, by their z score."""
    a, b = F.col(kind) + 0.5, F.col("n") - F.col(kind) + 0.5
    odds = F.log(a / (positive + 1)) - F.log(b / (n - positive + 1))
    scored = counts.select("piece", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).filter("abs(z) > 2")
    return {r["piece"]: r["odds"] for r in scored.orderBy(F.abs("z").desc(), "piece").limit(limit).collect()}


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def _logit(p: Column) -> Column:
    c = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(c / (1 - c))


def _strength(groups: DataFrame, mean: Column, parent: Column, floor: float = 2.0, ceiling: float = 1e4) -> float:
    """Beta concentration from the variance of group means about their parents beyond what sampling alone gives."""
    spread = F.sum(F.col("n") * (mean - parent) * (mean - parent)) / F.sum("n")
    within = F.sum(parent * (1 - parent)) / F.sum("n")
    r = groups.agg((spread - within).alias("between"), (F.sum(F.col("n") * parent * (1 - parent)) / F.sum("n")).alias("v")).first()
    if not r["v"] or r["between"] is None or r["between"] <= 0:
        return ceiling
    return float(min(ceiling, max(floor, r["v"] / r["between"] - 1)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", sample: int = SAMPLE, vocabulary: int = VOCABULARY, rare: int = RARE) -> DataFrame:
    """(uid, doc_id, kept, p_low, p_toxic, p_doc, p_site, p_good) for every row; ``uid`` hashes its id and text."""
    base = docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
    )
    picked = staged(labelled_sample(labels, sample), "sample")
    # At most ``sample`` ids, so small enough to broadcast.
    one = base.select("doc_id", "uid", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("uid").alias("uid"))
    chosen = staged(one.join(picked, "doc_id"), "chosen")
    told = base.select("doc_id", "uid", "text").join(F.broadcast(chosen.filter("fold = 0")), ["doc_id", "uid"]).dropDuplicates(["doc_id"]).select("text", "bad", "toxic")
    counts = staged(told.mapInPandas(_count, "piece string, n long, bad double, toxic double").groupBy("piece").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "toxic")]).filter(F.col("n") >= rare), "pieces")
    size = picked.filter("fold = 0").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("toxic").alias("toxic")).first()
    odds = {k: word_odds(counts, size["n"], size[k], k, vocabulary) if size["n"] and 0 < (size[k] or 0) < size["n"] else {} for k in ("bad", "toxic")}
    schema = "uid long, doc_id long, host string, path string, n_words long, x array<double>"
    seen = staged(base.mapInPandas(_evidence(odds["bad"], odds["toxic"]), schema), "evidence")
    fit = seen.select("doc_id", "uid", "x").join(F.broadcast(chosen.filter("fold = 1")), ["doc_id", "uid"]).dropDuplicates(["doc_id"]).orderBy("doc_id").select("x", "bad", "toxic").toPandas()
    chance = {}
    for k in ("bad", "toxic"):
        y = fit[k].to_numpy() if len(fit) else np.zeros(0)
        if not (0 < y.sum() < len(y)):
            chance[k] = F.lit(0.0)
            continue
        w, b = logistic(np.stack(fit["x"].to_numpy()), y)
        score = F.lit(b)
        for i, v in enumerate(w):
            score = score + F.lit(float(v)) * F.get("x", F.lit(i))
        chance[k] = _sigmoid(score)
    own = seen.select("uid", "doc_id", "host", "path", "n_words", chance["bad"].alias("p_low"), chance["toxic"].alias("p_toxic"))
    own = own.withColumn("p_doc", F.when(F.col("n_words") == 0, 0.0).otherwise((1 - F.col("p_low")) * (1 - F.col("p_toxic"))))
    paths = staged(own.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s")), "paths")
    hosts = staged(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    m0 = min(1 - 1e-6, max(1e-6, (total["s"] or 0.0) / total["n"])) if total["n"] else 0.5
    k0 = _strength(hosts, F.col("s") / F.col("n"), F.lit(m0))
    above = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    nested = staged(paths.join(above, "host"), "nested")
    k1 = _strength(nested, F.col("s") / F.col("n"), (F.col("host_s") + k0 * m0) / (F.col("host_n") + k0))
    # Without the document itself.
    of_host = (F.col("host_s") - F.col("p_doc") + k0 * m0) / (F.col("host_n") - 1 + k0)
    of_path = (F.col("s") - F.col("p_doc") + k1 * of_host) / (F.col("n") - 1 + k1)
    good = _sigmoid(_logit(F.col("p_doc")) + _logit(F.col("p_site")) - _logit(F.lit(m0)))
    j = own.join(nested, ["host", "path"], "left").withColumn("p_site", of_path).withColumn("p_good", F.when(F.col("n_words") == 0, 0.0).otherwise(good))
    return j.select("uid", "doc_id", (F.col("p_good") >= 0.5).alias("kept"), "p_low", "p_toxic", "p_doc", "p_site", "p_good")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns."""
    kept = staged(classify(docs, labels, id_col, text_col, **kw).filter("kept").select("uid").distinct(), "kept")
    rows = docs.select(F.struct("*").alias("row")).withColumn("uid", F.xxhash64(F.col(f"row.{id_col}"), F.col(f"row.{text_col}")))
    return rows.hint("merge").join(kept, "uid", "left_semi").select("row.*")  # the ids kept grow with the input


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """Decision and posteriors for every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("uid")
