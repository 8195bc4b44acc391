"""End-to-end runs: features to clusters to pairs, news matching, stability, question-answer corpora."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream import frames
from lodestream.functions import columns as C
from lodestream.functions import replies
from lodestream.operators import clustering, pairs, qa, retrieval, series, stability, text


MOST_BENCHMARKS = 256


@dataclass
class Perspective:
    """A named set of feature columns; ``clip`` are winsorised first."""

    name: str
    features: list[str]
    clip: list[str] = field(default_factory=list)


RETURN_RISK = Perspective(
    "return_risk_profile",
    ["return_1y", "return_3y", "return_5y", "average_yearly_return", "mean_daily_log_return", "dividend_yield_pct", "monthly_volatility", "volatility_30d", "annualized_volatility", "return_to_risk_1y", "sharpe_ratio", "concentration_top10"],
    ["return_1y", "return_3y", "return_5y", "average_yearly_return"],
)


def default_perspectives(features: DataFrame) -> list[Perspective]:
    """Returns, risks and the betas of all benchmarks; and the correlations with them."""
    named = lambda kind: sorted(c for c in features.columns if c.startswith(kind))
    return [Perspective(RETURN_RISK.name, RETURN_RISK.features + named("beta_"), RETURN_RISK.clip), Perspective("macro_sensitivity", named("corr_"))]


def feature_table(bars: DataFrame, benchmarks: DataFrame | None = None, metadata: DataFrame | None = None, least: int = 200) -> DataFrame:
    """One row a ticker: metadata left-joined with return, risk, correlation and beta features, numbers mean-filled."""
    f = series.risk_features(bars, least).join(series.monthly_volatility(bars).drop("months"), "ticker", "left")
    if benchmarks is not None:
        cb = series.correlation_and_beta(bars, benchmarks)
        names = sorted(r[0] for r in benchmarks.select("ticker").distinct().limit(MOST_BENCHMARKS + 1).collect())
        if len(names) > MOST_BENCHMARKS:
            raise ValueError(f"more than {MOST_BENCHMARKS} benchmarks, each of which would be two columns")
        token = lambda n: "".join(ch for ch in n.lower() if ch.isalnum())
        wide = cb.groupBy("ticker").agg(*[F.max(F.when(F.col("benchmark") == n, F.col(v))).alias(f"{v}_{token(n)}") for n in names for v in ("corr", "beta")])
        f = f.join(wide, "ticker", "left")
    out = f if metadata is None else metadata.join(f, "ticker", "left")
    return frames.mean_fill(out, [c for c, t in out.dtypes if t == "double"])


def cluster_views(features: DataFrame, perspectives: list[Perspective], forced_k: int | None = None) -> DataFrame:
    """(ticker, perspective, cluster_id, selected_k, pcs): a perspective with fewer than two known columns is left out."""
    out = None
    for p in perspectives:
        cols = [c for c in p.features if c in features.columns]
        if len(cols) < 2:
            continue
        x = frames.mean_fill(features.select("ticker", *cols), cols).na.fill(0.0, cols)
        x = frames.winsorise(x, [c for c in p.clip if c in cols]) if p.clip else x
        z = clustering.standardise(x.select("ticker", F.array(*cols).alias("x")))
        pcs = frames.materialise(clustering.principal_components(z).select("ticker", "pcs"))
        view = clustering.best_kmeans(pcs, forced_k, "pcs").withColumn("selected_k", F.lit(forced_k)) if forced_k else clustering.auto_kmeans(pcs, "ticker", "pcs")
        view = view.select("ticker", F.lit(p.name).alias("perspective"), "cluster_id", "selected_k", "pcs")
        out = view if out is None else out.unionByName(view)
    return out


def advise(views: DataFrame, labels: DataFrame, label_cols: list[str], geo: str, most: float = 2.0, least: int = 2, cap: int = 10, strict_compat: bool = False) -> dict[str, DataFrame]:
    """Home-bias and hidden-twin pairs under the degree cap. With ``strict_compat`` only perspectives of the largest
    number of components give pairs, as in a wide table that has nulls for the others."""
    v = views.join(labels, "ticker", "left").withColumn("geo", F.col(geo))
    if strict_compat:
        v = v.join(F.broadcast(v.agg(F.max(F.size("pcs")).alias("_n"))), F.size("pcs") == F.col("_n")).drop("_n")
    home = pairs.home_bias(v, most)
    twins = pairs.hidden_twins(v, label_cols, most, least)
    return {
        "home_bias": pairs.degree_capped(home, "source_ticker", "alternative_ticker", ["pc_distance", "perspective", "cluster_id"], cap),
        "hidden_twins": pairs.degree_capped(twins.withColumn("less", -F.col("mismatch_count")), "ticker_a", "ticker_b", ["less", "pc_distance", "perspective", "cluster_id"], cap).drop("less"),
    }


def run_dna_pipeline(bars: DataFrame, benchmarks: DataFrame, metadata: DataFrame, label_cols: list[str], geo: str, perspectives: list[Perspective] | None = None) -> dict[str, DataFrame]:
    features = frames.materialise(feature_table(bars, benchmarks, metadata))
    views = frames.materialise(cluster_views(features, perspectives or default_perspectives(features)))
    return {"features": features, "views": views, **advise(views, metadata.select("ticker", *{*label_cols, geo}), label_cols, geo)}


def run_news(queries: DataFrame, corpus: DataFrame, k: int = 3, preset: retrieval.Preset = retrieval.FAST, weight: float = 0.25) -> DataFrame:
    """(query_id, q, text, label, confidence) against (item, v, code, metadata, tags): ranked matches with sentiment."""
    first = retrieval.similar(queries.select("query_id", "q"), corpus.select("item", "v"), max(k * preset.multiplier, k)).drop("rank")
    j = first.join(corpus.drop("v"), "item").join(queries.drop("q"), "query_id")
    b = retrieval.boost(C.canonical_query(F.col("text")), F.col("code"), F.col("metadata"), F.col("tags"), preset)
    r = retrieval.rerank(j.select("query_id", "item", "score", b.alias("boost"), F.lit(None).cast("double").alias("cross"), "label", "confidence"), k, preset)
    sign = C.sentiment_sign(F.col("label"))
    return r.select("query_id", "rank", "item", "final_score", "score", "boost", F.col("label").alias("sentiment_label"), sign.alias("sentiment_score"), C.adjusted_score(F.col("final_score"), sign, F.col("confidence"), weight).alias("sentiment_adjusted_score"))


def run_stability(spark: SparkSession, encode, corpus: DataFrame, concepts: int = 30, variants: int = 10, k: int = 5, epsilon: float = 0.01) -> dict[str, DataFrame]:
    """``encode`` maps the text column to an embedding column; pretrained encoders stay outside the engine."""
    h = stability.synthetic_headlines(spark, concepts, variants).withColumn("query_id", F.col("concept_id") * 1000 + F.col("variant_id"))
    ranked = retrieval.similar(h.select("query_id", encode(F.col("headline")).alias("q")), corpus, k)
    p = ranked.join(h.select("query_id", "concept_id", "domain", "variant_id"), "query_id").withColumn("item", F.col("item").cast("string"))
    by_concept = frames.materialise(stability.concept_stability(p, k, epsilon))
    return {"headlines": h.drop("query_id"), "concepts": by_concept, "domains": stability.domain_stability(by_concept)}


def run_side_by_side(queries: DataFrame, gold: DataFrame, corpora: dict[str, DataFrame], k: int = 3, preset: retrieval.Preset = retrieval.FAST) -> DataFrame:
    """One row a corpus: top-1 precision and top-k recall of the same labelled queries against each. ``gold`` (query_id, item)."""
    out = None
    for name, corpus in corpora.items():
        r = retrieval.evaluate(run_news(queries, corpus, k, preset), gold, k).select(F.lit(name).alias("corpus"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def _facts(sentences: DataFrame, key: str) -> DataFrame:
    """(key, fact, pos, value): first value of each fact. A sentence is read with the three after it, so that a heading may
    stand apart from its value; only a text's last sentence may end a value."""
    w = Window.partitionBy(key).orderBy("pos")
    ahead = F.concat_ws(" ", "text", *[F.lead("text", i).over(w) for i in (1, 2, 3)])
    d = sentences.withColumn("ahead", F.when(F.lead("text", 3).over(w).isNull(), ahead).otherwise(F.concat(ahead, F.lit(" ."))))
    d = d.select(key, "pos", replies.key_facts(F.col("ahead")).alias("f"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("fact"), F.col(f"f.{n}").alias("value")) for n in C.fixed.KEY_FACTS]))
    return frames.keep_first(d.select(key, "pos", each.alias("x")).select(key, "pos", "x.*").filter("value is not null"), [key, "fact"], F.col("pos"))


def generate_qa(sentences: DataFrame, key: str = "ticker", most: int = 240, least_chars: int = 40, most_chars: int = 900, seed: int = 42, bilingual: bool = True) -> DataFrame:
    """(key, id, question, answer, source_tag, language, pos): key facts, topics of two to four sentences and single
    sentences, each also in Chinese where its question has a translation; gated, the shortest sound answer a question, at
    most ``most`` a key in a hash order that depends on nothing but key and question.

    ``sentences`` (key, pos, text): noisy, short and repeated ones of a key go first."""
    d = sentences.select(key, "pos", C.squeezed(F.col("text")).alias("text")).filter(~C.is_noisy_sentence(F.col("text")) & (F.length("text") >= least_chars))
    d = frames.materialise(frames.keep_first(d, [key, "text"], F.col("pos")))
    name = F.col(key).cast("string")
    fill = lambda template, value: F.replace(template, F.lit("{}"), value)
    pick = lambda table, i: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v[i]))])[F.col("fact")]
    rank = F.create_map(*[x for i, n in enumerate(C.fixed.FACT_QUESTIONS) for x in (F.lit(n), F.lit(i))])[F.col("fact")]
    facts = _facts(d, key).select(key, F.struct(F.lit(0), rank, F.lit(0)).alias("o"), "pos", fill(pick(C.fixed.FACT_QUESTIONS, 0), name).alias("question"), fill(pick(C.fixed.FACT_QUESTIONS, 1), F.col("value")).alias("answer"), F.lit("fact_extraction").alias("source_tag"))
    place = F.create_map(*[x for i, n in enumerate(C.fixed.TOPIC_QUESTIONS) for x in (F.lit(n), F.lit(i))])[F.col("topic")]
    topics = qa.topic_answers(d, key, most_chars=most_chars, seed=seed).select(key, F.struct(F.lit(1), place, "n").alias("o"), "pos", "question", "answer", F.col("topic").alias("source_tag"))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(f"(?i){p}"), F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"))) for i, (p, q) in enumerate(C.fixed.SENTENCE_QUESTIONS)]))
    single = frames.top_n(d.select(key, "pos", "text", F.explode(hits).alias("h")).select(key, "pos", "text", "h.*"), [key, "i"], 3, F.col("pos"))
    single = single.select(key, F.struct(F.lit(2), "i", "rank").alias("o"), "pos", fill(F.col("q"), name).alias("question"), C.compact_answer(F.col("text"), most_chars).alias("answer"), F.lit("single_sentence").alias("source_tag"))
    plain = facts.union(topics.union(single).filter(F.length("answer") >= least_chars)).withColumn("language", F.lit("en"))
    if bilingual:
        zh = F.struct(F.lit("zh-HK").alias("language"), replies.chinese_question(F.col("question"), name).alias("question"), fill(F.lit(C.fixed.CHINESE_ANSWER), F.col("answer")).alias("answer"), F.concat("source_tag", F.lit("_zh")).alias("source_tag"))
        en = F.struct("language", "question", "answer", "source_tag")
        plain = plain.select(key, "o", "pos", F.explode(F.array(en, zh)).alias("x")).select(key, "o", "pos", "x.*").filter("question is not null")
    good = plain.filter(C.is_question(F.col("question"), F.col("language")) & ~C.is_bad_answer(F.col("answer"), F.col("source_tag")))
    best = qa.shortest_answers(good.withColumnRenamed("pos", "at").withColumnRenamed("o", "pos").withColumn("qk", C.question_key(F.col("question"))), [key, "language", "qk"], least_chars)
    ranked = frames.top_n(best, [key], most, F.md5(F.concat_ws(":", F.lit(str(seed)), name, "qk")), F.col("qk"))
    return ranked.select(key, F.concat_ws("-", name, F.lpad(F.col("rank").cast("string"), 4, "0")).alias("id"), "question", "answer", "source_tag", "language", F.col("at").alias("pos"))


def build_profiles(documents: DataFrame, key: str, body: str) -> DataFrame:
    return text.profiles(text.sentences(documents, key, body), key)
