"""Paraphrase generator and ranking-stability metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.functions import columns as C
from lodestream.functions import fixed


def _strings(xs) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def synthetic_headlines(spark: SparkSession, concepts: int = 100, variants: int = 20) -> DataFrame:
    """Deterministic: every list is indexed by (id - 1) modulo its length."""
    topics = F.array(*[F.struct(F.lit(t[0]).alias("domain"), F.lit(t[1]).alias("asset"), *[_strings(v).alias(n) for n, v in zip(("catalysts", "drivers", "regions", "themes"), t[2:], strict=True)]) for t in fixed.TOPICS])
    at = lambda xs, i: F.get(xs, ((i - 1) % F.size(xs)).cast("int"))
    c = F.col("concept_id")
    base = spark.range(1, concepts + 1).select(F.col("id").cast("int").alias("concept_id")).withColumn("t", at(topics, c))
    base = base.select("concept_id", "t.domain", "t.asset", *[at(F.col(f"t.{p}"), c).alias(n) for p, n in (("catalysts", "catalyst"), ("drivers", "driver"), ("regions", "region"), ("themes", "theme"))])
    v = base.withColumn("variant_id", F.explode(F.sequence(F.lit(1), F.lit(variants))))
    text = at(_strings(fixed.PARAPHRASES), F.col("variant_id"))
    for n in ("catalyst", "driver", "region", "theme", "asset"):
        text = F.replace(text, F.lit("{" + n + "}"), F.col(n))
    meaning = F.concat_ws(" ", "catalyst", F.lit("signals"), "driver", F.lit("for"), "region", "theme", "asset")
    return v.select("concept_id", "domain", "variant_id", F.col("region").alias("region_anchor"), F.col("theme").alias("theme_anchor"), meaning.alias("base_meaning"), text.alias("headline"))


def _mean(c: Column) -> Column:
    """Of finite values; 0 without any."""
    return F.coalesce(F.avg(F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)), F.lit(0.0))


def _corr(x: Column, y: Column) -> Column:
    """Pearson of two arrays; 0 where a side is constant. Each part is computed once a row."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    centred = lambda a: C.let(total(a) / F.size(a), lambda m: F.transform(a, lambda v: v - m))
    dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))

    def of(a: Column, b: Column) -> Column:
        parts = F.struct(dot(a, b).alias("xy"), dot(a, a).alias("xx"), dot(b, b).alias("yy"))
        return C.let(parts, lambda p: F.when((p["xx"] > 1e-18) & (p["yy"] > 1e-18), p["xy"] / F.sqrt(p["xx"] * p["yy"])).otherwise(0.0))

    return C.let(x, lambda u: C.let(centred(u), lambda a: C.let(y, lambda v: C.let(centred(v), lambda b: of(a, b)))))


def _ranks(x: Column) -> Column:
    """Average ranks."""
    return C.let(x, lambda a: F.transform(a, lambda v: F.size(F.filter(a, lambda u: u < v)) + (F.size(F.filter(a, lambda u: u == v)) + 1) / F.lit(2.0)))


def concept_stability(predictions: DataFrame, k: int = 5, epsilon: float = 0.01) -> DataFrame:
    """(concept_id, domain, variant_id, rank, item, score) to one row a concept; fewer than two variants give none."""
    top = predictions.filter(F.col("rank") <= k).groupBy("concept_id", "domain", "variant_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("x"))
    v = top.select(
        "concept_id", "domain", "variant_id", F.transform("x", lambda s: s["item"]).alias("items"), F.transform("x", lambda s: s["score"]).alias("scores"),
        F.min(F.array_min(F.transform("x", lambda s: s["score"]))).over(Window.partitionBy("concept_id")).alias("low"),
    )
    first, last = F.get("scores", F.lit(0)), F.try_element_at("scores", F.lit(-1))
    v = v.withColumn("spread", F.when(F.size("scores") >= 2, first - last)).withColumn("tied", F.filter("items", lambda i: (first - F.get(F.col("scores"), (F.array_position("items", i) - 1).cast("int"))) <= epsilon))
    a = v.select("concept_id", F.col("variant_id").alias("va"), F.col("items").alias("ia"), F.col("scores").alias("sa"), F.col("tied").alias("ta"), "low")
    b = v.select("concept_id", F.col("variant_id").alias("vb"), F.col("items").alias("ib"), F.col("scores").alias("sb"), F.col("tied").alias("tb"))
    p = a.join(b, "concept_id").filter("va < vb").withColumn("all", F.array_sort(F.array_union("ia", "ib")))
    aligned = lambda items, scores: F.transform("all", lambda t: F.when(F.array_contains(items, t), F.get(F.col(scores), (F.array_position(items, t) - 1).cast("int"))).otherwise(F.col("low") - 0.05))
    p = p.withColumn("xa", aligned(F.col("ia"), "sa")).withColumn("xb", aligned(F.col("ib"), "sb")).withColumn("n", F.least(F.size("sa"), F.size("sb")))
    gap = lambda s: F.get(s, F.lit(0)) - F.try_element_at(s, F.lit(-1))
    pair = p.select(
        "concept_id", C.jaccard(F.col("ia"), F.col("ib")).alias("j"), C.ranked_jaccard(F.col("ia"), F.col("ib")).alias("rj"), _corr(F.col("xa"), F.col("xb")).alias("cp"), _corr(_ranks(F.col("xa")), _ranks(F.col("xb"))).alias("cs"),
        _corr(F.slice("sa", F.lit(1), F.col("n")), F.slice("sb", F.lit(1), F.col("n"))).alias("rc"), F.abs(gap(F.col("sa")) - gap(F.col("sb"))).alias("g"), C.jaccard(F.col("ta"), F.col("tb")).alias("tj"),
    ).groupBy("concept_id").agg(*[_mean(F.col(c)).alias(c) for c in ("j", "rj", "cp", "cs", "rc", "g", "tj")])
    tops = v.groupBy("concept_id", F.get("items", F.lit(0)).alias("i")).agg(F.count("*").alias("n")).groupBy("concept_id").agg((F.max("n") / F.sum("n")).alias("top1"))
    own = v.groupBy("concept_id").agg(F.min("domain").alias("domain"), _mean(F.col("spread")).alias("spread"), F.count("*").alias("variants"))
    r4 = lambda c: F.bround(c, 4)
    j = own.filter("variants >= 2").join(pair, "concept_id").join(tops, "concept_id")
    total = 0.30 * F.col("j") + 0.20 * F.col("rj") + 0.20 * F.col("top1") + 0.20 * F.col("tj") + 0.10 * F.col("rc")
    return j.select(
        "concept_id", "domain", r4("j").alias("avg_topk_jaccard"), r4("rj").alias("avg_rank_weighted_jaccard"), r4("top1").alias("top1_consistency"), r4("cp").alias("avg_score_corr_ticker_pearson"),
        r4("cs").alias("avg_score_corr_ticker_spearman"), r4("rc").alias("avg_rank_score_corr"), r4("g").alias("avg_score_gap_delta"), r4("spread").alias("avg_score_spread"), r4("tj").alias("avg_tie_bucket_jaccard"),
        r4(total).alias("composite_stability_score"), "variants",
    )


def domain_stability(concepts: DataFrame) -> DataFrame:
    """Means of the rounded concept values, rounded again."""
    values = [c for c in concepts.columns if c not in ("concept_id", "domain", "variants")]
    name = lambda c: c if c.startswith("avg_") else f"avg_{c}"
    return concepts.groupBy("domain").agg(F.count("*").alias("concepts"), *[F.bround(F.avg(c), 4).alias(name(c)) for c in values])
