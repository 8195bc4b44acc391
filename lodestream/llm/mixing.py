"""Mixing sources to target weights with soft memberships (operator 3, native).

A naive Bayes classifier over hashed words, fitted on a labelled table by grouped sums, gives every document a posterior
over the table's domains, whatever they are. It is fitted on at most ``SAMPLE`` labels (smallest hash of the id first) with
``BUCKETS`` word buckets, both parameters. Documents get nonnegative rates r such that the expected domain tokens
sum_i r_i t_i p_ik meet the targets T_k in the least squares sense, each domain weighted by its present size S_k: minimise
sum_k (S_k(r) - T_k)^2 / (2 S_k). Projected gradient with the metric of the documents' tokens moves r_i by
-sum_k p_ik (S_k(r) - T_k) / S_k and cuts at 0; the step matrix has row sums 1, so the unit step is stable, and nearly hard
memberships converge in a few rounds.

As a rate depends on the posterior alone, posteriors are rounded to a grid of 1/``GRID`` and documents of one grid point
are aggregated before the rounds: a round sums over grid points, however many documents there are. Only K sums a round
reach the driver; the rate of a document is the fold of these few vectors over its own posterior.

The default budget is a hundredth over the smallest at which no domain needs fewer tokens than it has, so mixing repeats
documents and leaves none out of any domain; a smaller budget thins the large ones by a hash of the document.

Defined results: a null or empty text has 0 tokens, the prior as posterior, and its rate; targets for unseen domains are
ignored, domains without a target keep their share; targets that are all 0 leave every rate at 1; null labels are ignored; without labels all documents are one
domain at rate 1; equal rows get equal rates; other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.llm.common import let, numbers, staged, table

SAMPLE = 20_000
BUCKETS = 8192
DOMAINS = 256
SMOOTHING = 256.0
HITS = 8.0
GRID = 32
ROUNDS = 60
WRITE = 5


def words(text: Column) -> Column:
    """The words of a text, as ``packing.n_words`` counts them, in lower case."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.filter(F.split(t, " "), lambda w: w != "")


def hashed(tokens: Column, buckets: int = BUCKETS) -> Column:
    return F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def fit_domains(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, limit: int = DOMAINS):
    """Grouped sums to (domains, log priors, log word rates by bucket). ``docs`` (doc_id, text); ``labelled`` (doc_id,
    domain), of which an id counts with its least domain; more than ``limit`` domains are an error, as each is a row of
    the model that every task holds."""
    told = labelled.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    told = staged(told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "told")  # so small that it may be broadcast
    sizes = {r["domain"]: r["n"] for r in told.groupBy("domain").agg(F.count("*").alias("n")).limit(limit + 1).collect()}
    if len(sizes) > limit:
        raise ValueError(f"more than {limit} domains")
    domains = sorted(sizes)
    prior = [math.log(sizes[d] / sum(sizes.values())) for d in domains]
    met = docs.join(F.broadcast(told), "doc_id").select("domain", F.explode(hashed(words(F.col("text")), buckets)).alias("b"))
    counts = [[0] * buckets for _ in domains]
    for r in met.groupBy("domain", "b").agg(F.count("*").alias("n")).collect():
        counts[domains.index(r["domain"])][r["b"]] = r["n"]
    # Smoothed toward the words of all domains, so that a word seen nowhere speaks for none.
    every = [sum(c) for c in zip(*counts, strict=True)] if domains else []
    total = sum(every)
    base = [(x + 1.0) / (total + buckets) for x in every]
    rates = [[math.log((x + SMOOTHING * g) / (total_of + SMOOTHING)) if n else math.log(g) for x, g, n in zip(c, base, every, strict=True)] for c, total_of in ((c, sum(c)) for c in counts)]
    return domains, prior, rates


def posterior(idx: Column, prior: list[float], rates: list[list[float]], hits: float = HITS) -> Column:
    """Posterior in units of 1/GRID, an int array that sums to about GRID. The evidence of a text counts as at most ``hits``
    words, which keeps the memberships of long texts with words of several domains soft."""

    k = len(prior)
    by_bucket = numbers([round(r[b], 9) for b in range(len(rates[0])) for r in rates])  # the k rates of a bucket side by side

    def scores(i: Column) -> Column:
        n = F.size(i)
        scale = F.when(n > hits, F.lit(hits) / n).otherwise(F.lit(1.0))
        told = F.aggregate(i, numbers([0.0] * k), lambda s, b: F.zip_with(s, F.slice(by_bucket, b * k + 1, F.lit(k)), lambda x, y: x + y))
        return F.zip_with(numbers(prior), told, lambda p, x: p + scale * x)

    def soft(s: Column) -> Column:
        return let(F.transform(s, lambda x: F.exp(x - F.array_max(s))), lambda e: F.transform(e, lambda x: F.round(x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b) * GRID).cast("int")))

    return let(idx, lambda i: let(scores(i), soft))


def _shares(q: Column) -> Column:
    return let(q, lambda v: let(F.aggregate(v, F.lit(0), lambda a, b: a + b), lambda s: F.transform(v, lambda x: F.try_divide(x.cast("double"), s))))


def _moved(rate: Column, p: Column, step: Column) -> Column:
    return F.greatest(F.lit(0.0), rate - F.aggregate(F.zip_with(p, step, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def rate_of(p: Column, steps: list[list[float]]) -> Column:
    """The rate after the recorded steps: each subtracts its dot product with ``p``, then cuts at 0. All steps are one literal."""
    if not steps:
        return F.lit(1.0)
    k, every = len(steps[0]), numbers([x for s in steps for x in s])
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.lit(1.0), lambda r, t: _moved(r, p, F.slice(every, t * k + 1, F.lit(k))))


def fit_rates(groups: DataFrame, domains: list[str], targets: dict[str, float] | None, budget: float | None = None, rounds: int = ROUNDS, close: float = 1e-7, scale: float | None = None):
    """(steps, sums, wanted). ``groups`` (p, w): posterior and tokens. ``targets``: weights by domain; None: the square
    roots of the present sizes. ``budget`` in tokens, or ``scale`` times the present ones.

    The rate is a column of the grid points, which a round moves by one step; it is written every ``WRITE`` rounds, so that
    the plan of a round does not grow with the rounds before, nor with the domains, whose sums are grouped rows."""

    def sums(g: DataFrame) -> list[float]:
        parts = g.select((F.col("w") * F.col("r")).alias("m"), F.posexplode("p").alias("k", "x")).filter("x > 0")
        by = {r["k"]: r["s"] for r in parts.groupBy("k").agg(F.sum(F.col("m") * F.col("x")).alias("s")).collect()}
        return [float(by.get(i) or 0) for i in range(len(domains))]

    rated = groups.select("p", "w", F.lit(1.0).alias("r"))
    have = sums(rated)
    total = sum(have)
    if not total:
        return [], have, have
    weight = [math.sqrt(h) for h in have] if targets is None else [targets.get(d, h / total) if h else 0.0 for d, h in zip(domains, have, strict=True)]
    if not sum(weight):
        return [], have, have
    goal = [w / sum(weight) for w in weight]
    budget = budget or (scale * total if scale else 1.01 * max(h / g for h, g in zip(have, goal, strict=True) if g))
    wanted = [g * budget for g in goal]
    steps: list[list[float]] = []
    now = have
    for n in range(rounds):
        steps.append([(x - w) / h if h else 0.0 for x, w, h in zip(now, wanted, have, strict=True)])
        rated = rated.withColumn("r", _moved(F.col("r"), F.col("p"), numbers(steps[-1])))
        if n % WRITE == WRITE - 1:
            rated = staged(rated, "rates")
        now = sums(rated)
        if max(abs(x - w) for x, w in zip(now, wanted, strict=True)) <= close * budget:
            break
    return steps, now, wanted


def plan(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, budget: float | None = None, sample: int = SAMPLE, scale: float | None = None):
    """Fit on all ``docs``; returns (scored, domains, rate column of a posterior, sums, wanted). ``scored`` (row, t, p) has
    every row of ``docs`` as a struct with its tokens and posterior, written once, so that texts are read a single time."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    domains, prior, rates = fit_domains(texts, labelled, sample)
    if not domains:
        domains, prior, rates = ["all"], [0.0], [[0.0] * BUCKETS]
    of = lambda ws: F.struct(F.size(ws).cast("long").alias("t"), posterior(hashed(ws), prior, rates).alias("q"))
    rows = docs.select(F.struct("*").alias("row"))
    scored = staged(rows.select("row", let(words(F.col(f"row.`{text_col}`")), of).alias("x")).select("row", "x.t", "x.q"), "scored")
    groups = staged(scored.groupBy("q").agg(F.sum("t").cast("double").alias("w")).select(_shares(F.col("q")).alias("p"), "w"), "groups")
    steps, now, wanted = fit_rates(groups, domains, targets, budget, scale=scale)
    return scored.select("row", "t", _shares(F.col("q")).alias("p")), domains, lambda p: rate_of(p, steps), now, wanted


def copies(rate: Column, *identity: Column) -> Column:
    """A whole number of copies with the mean ``rate``: the fraction is met by a hash of the document."""
    u = F.pmod(F.xxhash64(F.lit(17), *identity), F.lit(1_000_000)) / 1e6
    return (F.floor(rate + 1e-9) + F.when(u < rate + 1e-9 - F.floor(rate + 1e-9), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, budget: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says, all columns; the texts are not shuffled."""
    scored, _, rate, _, _ = plan(docs, labelled, id_col, text_col, targets, budget)
    n = scored.select("row", copies(rate(F.col("p")), F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")).alias("n")).filter("n > 0")
    return n.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")


def labelled_domains(docs: DataFrame, labels: DataFrame, domain_col: str = "lang") -> DataFrame:
    """(doc_id, domain): ``domain_col`` of the documents that are labelled good and clean."""
    good = labels.filter("quality = 1 and toxic = 0").select("doc_id").distinct()
    return docs.select("doc_id", F.col(domain_col).alias("domain")).join(good, "doc_id", "left_semi")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Tokens, domain posterior, rate and copies of every document, for even shares of as many tokens as there are: domains
    above their share are thinned, the others repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = labelled_domains(docs, table(spark, sf_dir, "labels"))
    even = {r["domain"]: 1.0 for r in told.select("domain").distinct().limit(DOMAINS + 1).collect()}
    scored, domains, rate, _, _ = plan(docs.select("doc_id", "text"), told, targets=even, scale=1.0)
    top = F.get(F.array(*[F.lit(d) for d in domains]), (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    out = scored.select("row.doc_id", F.col("t").alias("n_tokens"), top.alias("domain"), "p", rate(F.col("p")).alias("rate"))
    return out.select("doc_id", "n_tokens", "domain", F.array_join(F.transform("p", lambda x: F.format_number(x, 4)), ",").alias("posterior"), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))
