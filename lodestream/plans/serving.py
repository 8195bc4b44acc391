"""Queries over retrieval, news, stability, questions and answers, and serving, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream import frames
from lodestream.frames import read
from lodestream.functions import columns as C
from lodestream.functions import fixed, replies
from lodestream.operators import qa, retrieval, stability
from lodestream.plans.documents import _any_sql, _quote

Q: dict = {}
SQL: dict[str, str] = {}
EVERY, K = 100, 5


def query(f):
    Q[f.__name__] = f
    return f


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _corpus(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"), F.col("label").alias("item_label"))


def _queries(spark, d):
    return read(spark, d, "embeddings").filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("query_label"))


_DOT = """e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, q.label AS query_label, c.vec_id AS item, c.label AS item_label, list_dot_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id % 100 = 0)"""


@query
def semantic_topk(spark, d):
    return rounded(retrieval.similar(_queries(spark, d).select("query_id", "q"), _corpus(spark, d), K))


SQL["semantic_topk"] = f"WITH {_DOT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM p) SELECT query_id, item, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"


def _boosted(spark, d):
    first = retrieval.similar(_queries(spark, d).select("query_id", "q"), _corpus(spark, d), K * retrieval.FAST.multiplier)
    part = read(spark, d, "part").select((F.col("p_partkey") - 1).alias("item"), F.array("p_brand", "p_type").alias("metadata"), F.split(F.replace("p_name", F.lit(" "), F.lit("_")), "_").alias("tags"))
    text = read(spark, d, "part").select((F.col("p_partkey") - 1).alias("query_id"), F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("text"))
    j = first.drop("rank").join(part, "item", "left").join(text, "query_id", "left")
    b = retrieval.boost(F.col("text"), C.digits_code(F.col("item"), 5), F.coalesce("metadata", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>")))
    return retrieval.rerank(j.select("query_id", "item", "score", b.alias("boost"), F.lit(None).cast("double").alias("cross")), K)


@query
def boosted_topk(spark, d):
    return rounded(_boosted(spark, d).drop("cross"))


SQL["boosted_topk"] = f"""WITH {_DOT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS i FROM p),
j AS (SELECT r.query_id, r.item, r.score, lower(t.p_name || ' ' || t.p_brand || ' ' || t.p_partkey) AS text, m.p_brand, m.p_type, string_split(replace(m.p_name, ' ', '_'), '_') AS tags
  FROM r LEFT JOIN part t ON t.p_partkey - 1 = r.query_id LEFT JOIN part m ON m.p_partkey - 1 = r.item WHERE i <= 20),
b AS (SELECT query_id, item, score, CASE WHEN contains(text, item::VARCHAR) THEN 0.35 ELSE 0 END
  + 0.1 * (coalesce((length(p_brand) >= 4 AND contains(text, lower(trim(p_brand))))::INT, 0) + coalesce((length(p_type) >= 4 AND contains(text, lower(trim(p_type))))::INT, 0))
  + 0.1 * len([x FOR x IN coalesce(tags, []) IF x <> '' AND contains(text, x)]) AS boost FROM j),
f AS (SELECT *, score + boost AS final_score, row_number() OVER (PARTITION BY query_id ORDER BY score + boost DESC, item) AS rank FROM b)
SELECT query_id, item, round(score, 6) AS score, round(boost, 6) AS boost, round(final_score, 6) AS final_score, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 5"""


def _logit(a, b):
    """What a cross-encoder would hand in for a pair: here eight times the product of the last sixteen components."""
    return 8 * F.aggregate(F.zip_with(F.slice(a, -16, 16), F.slice(b, -16, 16), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


@query
def cross_reranked(spark, d):
    """The slower preset: six times as many candidates, of which the first 24 of a query get a second score."""
    asked, corpus, p = _queries(spark, d).select("query_id", "q"), _corpus(spark, d), retrieval.QUALITY
    first = frames.materialise(retrieval.similar(asked, corpus, K * p.multiplier)).drop("rank")
    part = read(spark, d, "part").select((F.col("p_partkey") - 1).alias("item"), F.array("p_brand", "p_type").alias("metadata"))
    text = read(spark, d, "part").select((F.col("p_partkey") - 1).alias("query_id"), F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string")).alias("text"))
    none = F.array().cast("array<string>")
    j = first.join(part, "item", "left").join(text, "query_id", "left").join(asked, "query_id").join(corpus.select("item", "v"), "item")
    b = retrieval.boost(F.col("text"), C.digits_code(F.col("item"), 5), F.coalesce("metadata", none), none, p)
    wide = lambda c: F.col(c).cast("array<double>")
    return rounded(retrieval.rerank(j.select("query_id", "item", "score", b.alias("boost"), _logit(wide("q"), wide("v")).alias("cross")), K, p))


SQL["cross_reranked"] = f"""WITH {_DOT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS i FROM p),
j AS (SELECT r.query_id, r.item, r.score, i, lower(t.p_name || ' ' || t.p_brand || ' ' || t.p_partkey) AS text, m.p_brand, m.p_type, 8 * list_dot_product(a.v[49:64], b.v[49:64]) AS logit
  FROM r LEFT JOIN part t ON t.p_partkey - 1 = r.query_id LEFT JOIN part m ON m.p_partkey - 1 = r.item JOIN e a ON a.vec_id = r.query_id JOIN e b ON b.vec_id = r.item WHERE i <= 30),
b AS (SELECT query_id, item, score, logit, i, coalesce(CASE WHEN contains(text, item::VARCHAR) THEN 0.35 ELSE 0 END
  + 0.12 * (coalesce((length(p_brand) >= 4 AND contains(text, lower(trim(p_brand))))::INT, 0) + coalesce((length(p_type) >= 4 AND contains(text, lower(trim(p_type))))::INT, 0)), 0) AS boost FROM j),
f AS (SELECT *, score + boost + CASE WHEN i <= 24 THEN 0.20 / (1 + exp(-logit)) ELSE 0 END AS final_score FROM b),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, item) AS rank FROM f)
SELECT query_id, item, round(score, 6) AS score, round(boost, 6) AS boost, round(logit, 6) AS cross, round(final_score, 6) AS final_score, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 5"""


@query
def retrieval_eval(spark, d):
    own = _queries(spark, d)
    ranked = retrieval.similar(own.select("query_id", "q"), _corpus(spark, d), K + 1).filter("query_id <> item")
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    gold = own.select("query_id", "query_label").join(_corpus(spark, d), F.col("query_label") == F.col("item_label")).select("query_id", "item")
    return rounded(retrieval.evaluate(ranked, gold, K))


SQL["retrieval_eval"] = f"""WITH {_DOT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS i FROM p),
s AS (SELECT query_id, query_label = item_label AS ok, row_number() OVER (PARTITION BY query_id ORDER BY i) AS rank FROM r WHERE i <= 6 AND query_id <> item),
g AS (SELECT query_id, max((rank = 1 AND ok)::INT) AS top1, max((rank <= 5 AND ok)::INT) AS hit FROM s GROUP BY 1)
SELECT count(*) AS labelled, round(avg(top1), 6) AS top1_precision, round(avg(hit), 6) AS topk_recall FROM g"""


@query
def lexical_overlap_rank(spark, d):
    b = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return rounded(retrieval.lexical(b, read(spark, d, "documents").select(F.col("doc_id").alias("item"), "text"), 3))


SQL["lexical_overlap_rank"] = r"""WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{4e00}-\x{9fff}]+')) AS ts FROM benchmark),
d AS (SELECT doc_id AS item, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{4e00}-\x{9fff}]+'))) AS t FROM documents),
h AS (SELECT query_id, item, count(*) / any_value(n) AS overlap FROM (SELECT query_id, len(ts) AS n, unnest(ts) AS t FROM q) JOIN d USING (t) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, item) AS rank FROM h)
SELECT query_id, item, round(overlap, 6) AS overlap, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3"""


@query
def query_text_compose(spark, d):
    p = F.from_json("props", "k long").getField("k").cast("string")
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (F.col("event_type"), F.concat(F.lit("user "), F.col("user_id").cast("string")), p)]
    return read(spark, d, "events").select("event_id", F.concat_ws(" | ", *parts).alias("query_text"), F.to_json(F.struct("event_id", "event_type")).alias("record"))


SQL["query_text_compose"] = """SELECT event_id, concat_ws(' | ', nullif(trim(event_type), ''), 'user ' || user_id, json_extract_string(props, '$.k')) AS query_text,
  '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS record FROM events"""

_SIGN = "CASE WHEN event_type IN ('click', 'purchase') THEN 'positive' WHEN event_type IN ('error', 'logout') THEN 'negative' ELSE 'neutral' END"


def _news(spark, d):
    label = F.when(F.col("event_type").isin("click", "purchase"), "positive").when(F.col("event_type").isin("error", "logout"), "negative").otherwise("neutral")
    sure = (F.col("event_id") % 10) / 10.0
    return read(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.col("value").alias("score"), label.alias("label")).withColumn("adjusted", C.adjusted_score(F.col("score"), C.sentiment_sign(F.col("label")), sure))


_NEWS = f"n AS (SELECT event_id, ts, user_id, event_type, value AS score, {_SIGN} AS label, round(value * (1 + 0.25 * CASE {_SIGN} WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 ELSE 0 END * ((event_id % 10) / 10.0::DOUBLE)), 6) AS adjusted FROM events)"


@query
def sentiment_adjusted_rank(spark, d):
    return frames.top_n(_news(spark, d), ["user_id"], 5, F.col("adjusted").desc(), F.col("event_id")).select("user_id", "rank", "event_id", "label", F.round("adjusted", 5).alias("adjusted"))


SQL["sentiment_adjusted_rank"] = f"WITH {_NEWS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY adjusted DESC, event_id) AS rank FROM n) SELECT user_id, CAST(rank AS INTEGER) AS rank, event_id, label, round(adjusted, 5) AS adjusted FROM r WHERE rank <= 5"


@query
def daily_news_score(spark, d):
    return rounded(_news(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.avg("score").alias("mean_score"), F.avg("adjusted").alias("mean_adjusted")), 4)


SQL["daily_news_score"] = f"WITH {_NEWS} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events, round(avg(score), 4) AS mean_score, round(avg(adjusted), 4) AS mean_adjusted FROM n GROUP BY 1"


@query
def event_user_top40(spark, d):
    c = _news(spark, d).groupBy("event_type", "user_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "event_type", "user_id").limit(40)
    return c


SQL["event_user_top40"] = "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, event_type, user_id LIMIT 40"


@query
def top_counts(spark, d):
    """Value counts with their share, ties by name."""
    n = _news(spark, d)
    c = n.groupBy("event_type", "label").agg(F.count("*").alias("n")).join(F.broadcast(n.agg(F.count("*").alias("total"))))
    return c.select("event_type", "label", "n", F.round(F.col("n") / F.col("total"), 6).alias("share")).orderBy(F.col("n").desc(), "event_type").limit(12)


SQL["top_counts"] = f"WITH {_NEWS} SELECT event_type, label, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM n GROUP BY 1, 2 ORDER BY n DESC, event_type LIMIT 12"


@query
def discovery_best_per_key(spark, d):
    n = _news(spark, d).withColumn("s", F.round(0.65 * F.col("score") / 100 + 0.35 * F.col("adjusted") / 100, 6))
    best = frames.keep_first(n, ["user_id"], F.col("s").desc(), F.col("event_id"))
    return frames.top_n(best.withColumn("one", F.lit(1)), ["one"], 3, F.col("s").desc(), F.col("user_id")).select("rank", "user_id", "event_id", "s")


SQL["discovery_best_per_key"] = f"""WITH {_NEWS}, s AS (SELECT *, round(0.65 * score / 100 + 0.35 * adjusted / 100, 6) AS s FROM n),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_id) AS i FROM s), t AS (SELECT *, row_number() OVER (ORDER BY s DESC, user_id) AS rank FROM b WHERE i = 1)
SELECT CAST(rank AS INTEGER) AS rank, user_id, event_id, s FROM t WHERE rank <= 3"""


@query
def alerts(spark, d):
    """Per user: scores over a threshold, newest first, distinct (day, type), the first 16, the best 8 of these."""
    n = _news(spark, d).filter(F.col("score") >= 70).withColumn("day", F.to_date("ts"))
    once = frames.keep_first(n, ["user_id", "day", "event_type"], F.col("score").desc(), F.col("event_id"))
    first = frames.top_n(once, ["user_id"], 16, F.col("day").desc(), F.col("score").desc(), F.col("event_id"), rank="age")
    return frames.top_n(first, ["user_id"], 8, F.col("score").desc(), F.col("event_id")).select("user_id", "rank", "age", "event_id", F.col("day").cast("string").alias("day"), F.round("score", 4).alias("score"))


SQL["alerts"] = """WITH n AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type, value AS score FROM events WHERE value >= 70),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id, day, event_type ORDER BY score DESC, event_id) AS i FROM n),
a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, score DESC, event_id) AS age FROM o WHERE i = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS rank FROM a WHERE age <= 16)
SELECT user_id, CAST(rank AS INTEGER) AS rank, CAST(age AS INTEGER) AS age, event_id, strftime(day, '%Y-%m-%d') AS day, round(score, 4) AS score FROM r WHERE rank <= 8"""


def _ranks(spark, d):
    """Every row is a variant, twenty neighbouring ids are a concept, predictions are the nearest rows of all."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    ranked = retrieval.similar(e, _corpus(spark, d), K)
    return ranked.select(F.floor(F.col("query_id") / 20).alias("concept_id"), (F.col("query_id") % 20 + 1).alias("variant_id"), "rank", "item", "score").select(
        "concept_id", F.concat(F.lit("d"), (F.col("concept_id") % 3).cast("string")).alias("domain"), "variant_id", "rank", F.col("item").cast("string").alias("item"), F.round("score", 6).alias("score")
    )


@query
def stability_concept(spark, d):
    return stability.concept_stability(_ranks(spark, d), K)


@query
def stability_domain(spark, d):
    return stability.domain_stability(stability.concept_stability(_ranks(spark, d), K))


_STAB = """WITH e AS (SELECT vec_id, vec_id // 20 AS label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v, vec_id % 20 + 1 AS i FROM embeddings),
p AS (SELECT q.label AS c, q.i AS v, x.vec_id AS item, list_dot_product(q.v, x.v) AS raw FROM e q, e x),
r AS (SELECT c, v, item, round(raw, 6) AS score, row_number() OVER (PARTITION BY c, v ORDER BY raw DESC, item) AS rank FROM p QUALIFY rank <= 5),
lo AS (SELECT c, min(score) - 0.05 AS floor FROM r GROUP BY c),
ends AS (SELECT c, v, max(score) AS hi, min(score) AS low, count(*) AS n FROM r GROUP BY c, v),
tie AS (SELECT r.c, r.v, r.item FROM r JOIN ends USING (c, v) WHERE hi - score <= 0.01),
pr AS (SELECT a.c, a.v AS va, b.v AS vb FROM ends a JOIN ends b ON a.c = b.c AND a.v < b.v),
al AS (SELECT pr.c, va, vb, u.item, a.score AS sa, b.score AS sb, a.rank AS ra, b.rank AS rb FROM pr
  JOIN (SELECT DISTINCT pr.c, va, vb, item FROM pr JOIN r ON r.c = pr.c AND (r.v = va OR r.v = vb)) u USING (c, va, vb)
  LEFT JOIN r a ON a.c = u.c AND a.v = va AND a.item = u.item LEFT JOIN r b ON b.c = u.c AND b.v = vb AND b.item = u.item),
fx AS (SELECT al.c, va, vb, item, coalesce(sa, floor) AS x, coalesce(sb, floor) AS y, ra, rb FROM al JOIN lo USING (c)),
rk AS (SELECT *, rank() OVER (PARTITION BY c, va, vb ORDER BY x) + (count(*) OVER (PARTITION BY c, va, vb, x) - 1) / 2 AS kx, rank() OVER (PARTITION BY c, va, vb ORDER BY y) + (count(*) OVER (PARTITION BY c, va, vb, y) - 1) / 2 AS ky FROM fx),
m1 AS (SELECT c, va, vb, count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) / count(*) AS j,
  sum(least(coalesce(1 / log2(ra + 1), 0), coalesce(1 / log2(rb + 1), 0))) / sum(greatest(coalesce(1 / log2(ra + 1), 0), coalesce(1 / log2(rb + 1), 0))) AS rj,
  CASE WHEN var_pop(x) > 1e-15 AND var_pop(y) > 1e-15 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END AS cp,
  CASE WHEN var_pop(kx) > 1e-15 AND var_pop(ky) > 1e-15 THEN covar_pop(kx, ky) / (stddev_pop(kx) * stddev_pop(ky)) ELSE 0 END AS cs FROM rk GROUP BY c, va, vb),
m2 AS (SELECT pr.c, va, vb, covar_pop(a.score, b.score) / (stddev_pop(a.score) * stddev_pop(b.score)) AS rc FROM pr JOIN r a ON a.c = pr.c AND a.v = va JOIN r b ON b.c = pr.c AND b.v = vb AND b.rank = a.rank GROUP BY 1, 2, 3),
m3 AS (SELECT pr.c, va, vb, abs((a.hi - a.low) - (b.hi - b.low)) AS g FROM pr JOIN ends a ON a.c = pr.c AND a.v = va JOIN ends b ON b.c = pr.c AND b.v = vb),
m4 AS (SELECT pr.c, va, vb, (SELECT count(*) FROM tie a JOIN tie b ON a.item = b.item WHERE a.c = pr.c AND a.v = va AND b.c = pr.c AND b.v = vb) AS i,
  (SELECT count(DISTINCT item) FROM tie a WHERE a.c = pr.c AND a.v IN (va, vb)) AS u FROM pr),
m AS (SELECT c, avg(j) AS j, avg(rj) AS rj, avg(cp) AS cp, avg(cs) AS cs, avg(rc) AS rc, avg(g) AS g, avg(i / u) AS tj FROM m1 JOIN m2 USING (c, va, vb) JOIN m3 USING (c, va, vb) JOIN m4 USING (c, va, vb) GROUP BY c),
t1 AS (SELECT c, max(n) / sum(n) AS top1 FROM (SELECT c, item, count(*) AS n FROM r WHERE rank = 1 GROUP BY 1, 2) GROUP BY c),
sp AS (SELECT c, avg(hi - low) AS spread, count(*) AS variants FROM ends GROUP BY c),
k AS (SELECT c AS concept_id, 'd' || (c % 3) AS domain, round_even(j, 4) AS avg_topk_jaccard, round_even(rj, 4) AS avg_rank_weighted_jaccard, round_even(top1, 4) AS top1_consistency,
  round_even(cp, 4) AS avg_score_corr_ticker_pearson, round_even(cs, 4) AS avg_score_corr_ticker_spearman, round_even(rc, 4) AS avg_rank_score_corr, round_even(g, 4) AS avg_score_gap_delta, round_even(spread, 4) AS avg_score_spread,
  round_even(tj, 4) AS avg_tie_bucket_jaccard, round_even(0.3 * j + 0.2 * rj + 0.2 * top1 + 0.2 * tj + 0.1 * rc, 4) AS composite_stability_score, variants FROM m JOIN t1 USING (c) JOIN sp USING (c))
"""
SQL["stability_concept"] = _STAB + "SELECT * FROM k"
SQL["stability_domain"] = _STAB + """SELECT domain, count(*) AS concepts, round_even(avg(avg_topk_jaccard), 4) AS avg_topk_jaccard, round_even(avg(avg_rank_weighted_jaccard), 4) AS avg_rank_weighted_jaccard,
  round_even(avg(top1_consistency), 4) AS avg_top1_consistency, round_even(avg(avg_score_corr_ticker_pearson), 4) AS avg_score_corr_ticker_pearson, round_even(avg(avg_score_corr_ticker_spearman), 4) AS avg_score_corr_ticker_spearman,
  round_even(avg(avg_rank_score_corr), 4) AS avg_rank_score_corr, round_even(avg(avg_score_gap_delta), 4) AS avg_score_gap_delta, round_even(avg(avg_score_spread), 4) AS avg_score_spread,
  round_even(avg(avg_tie_bucket_jaccard), 4) AS avg_tie_bucket_jaccard, round_even(avg(composite_stability_score), 4) AS avg_composite_stability_score FROM k GROUP BY domain"""


def _asked(spark, d):
    """All benchmark texts with a lead-in by id, so that themes and metadata words occur."""
    lead = F.get(F.array(*[F.lit(x) for x in _LEADS]), (F.col("item_id") % len(_LEADS)).cast("int"))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(lead, "text").alias("text"))


_LEADS = ["steel oil and gold ", "large brushed brass dividend ", "", "copper china tech "]


def _listed(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("bundle"))


def _hybrid(spark, d, k=5):
    """Parts as instruments, documents as risk profiles, event types as news."""
    q = frames.materialise(_asked(spark, d))
    risks = retrieval.candidates(q, read(spark, d, "documents").select((F.col("doc_id") * 7 + 1).alias("item"), "text"), 30).withColumnRenamed("item", "ticker")
    news = read(spark, d, "events").select((F.col("user_id") * 3).alias("ticker"), F.col("event_type").alias("text"), (F.col("value") / 100).alias("score"))
    return retrieval.hybrid(q, _listed(spark, d), risks, news, k)


@query
def hybrid_rank(spark, d):
    """.40 theme + .30 metadata + .25 normalised risk + .05 news for each query over the parts and what has a risk score."""
    return rounded(_hybrid(spark, d))


def _has_themes(table):
    return "[x FOR x IN [" + ", ".join(f"CASE WHEN {_any_sql('low', w)} THEN {_quote(k)} END" for k, w in table.items()) + "] IF x IS NOT NULL]"


_WORDS = r"list_distinct(regexp_extract_all(low, '[a-z0-9\x{4e00}-\x{9fff}]+'))"
_LISTED = "CASE item_id % 4 " + " ".join(f"WHEN {i} THEN {_quote(x)}" for i, x in enumerate(_LEADS)) + " END || text"
_HYBRID = rf"""a AS (SELECT item_id AS query_id, {_LISTED} AS text FROM benchmark),
q AS (SELECT query_id, {_WORDS} AS qt, {_has_themes(fixed.THEMES)} AS qth FROM (SELECT query_id, lower(text) AS low FROM a)),
m AS (SELECT ticker, name, {_WORDS} AS mt, {_has_themes(fixed.BUNDLE_THEMES)} AS mth FROM (SELECT p_partkey AS ticker, p_name AS name, lower(p_name || ' ' || p_brand || ' ' || p_type) AS low FROM part)),
dt AS (SELECT doc_id * 7 + 1 AS ticker, unnest({_WORDS}) AS t FROM (SELECT doc_id, lower(text) AS low FROM documents)),
ro AS (SELECT query_id, ticker, count(*) / any_value(n) AS score FROM (SELECT query_id, len(qt) AS n, unnest(qt) AS t FROM q) JOIN dt USING (t) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ticker) AS i, max(score) OVER (PARTITION BY query_id) AS top FROM ro QUALIFY i <= 30),
e AS (SELECT user_id * 3 AS ticker, {_WORDS} AS nt, max(value) / 100 AS ns FROM (SELECT *, lower(event_type) AS low FROM events) GROUP BY 1, 2),
nw AS (SELECT query_id, ticker, max(0.6::DOUBLE * len(list_intersect(qt, nt)) / len(qt) + 0.4::DOUBLE * ns) AS news FROM q, e GROUP BY 1, 2),
u AS (SELECT query_id, ticker FROM q, m UNION SELECT query_id, ticker FROM r),
j AS (SELECT u.query_id, u.ticker, coalesce(name, 'Unknown ETF') AS name, coalesce(len(list_intersect(qth, mth)) / greatest(len(qth), 1), 0) AS theme_score, coalesce(len(list_intersect(qt, mt)) / greatest(len(qt), 1), 0) AS metadata_score,
  coalesce(score, 0) AS risk_score, coalesce(news, 0) AS news_score, coalesce(score / greatest(top, 1e-6), 0) AS n FROM u JOIN q USING (query_id) LEFT JOIN m ON m.ticker = u.ticker LEFT JOIN r ON r.query_id = u.query_id AND r.ticker = u.ticker LEFT JOIN nw ON nw.query_id = u.query_id AND nw.ticker = u.ticker),
h AS (SELECT *, round(0.40::DOUBLE * theme_score + 0.30::DOUBLE * metadata_score + 0.25::DOUBLE * n + 0.05::DOUBLE * news_score, 9) AS final_score FROM j),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, ticker) AS rank FROM h)"""
SQL["hybrid_rank"] = f"WITH {_HYBRID} SELECT query_id, ticker, name, round(theme_score, 6) AS theme_score, round(metadata_score, 6) AS metadata_score, round(risk_score, 6) AS risk_score, round(news_score, 6) AS news_score, round(final_score, 6) AS final_score, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 5"


@query
def recommendation_card(spark, d):
    """The best instrument of each query with benchmark, cut risks, fee and three alternatives."""
    p = read(spark, d, "part").select(F.col("p_partkey").alias("ticker"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("benchmark"), F.when(F.col("p_size") % 2 == 0, F.floor("p_retailprice") / 1000).alias("fee"))
    risk = read(spark, d, "documents").select((F.col("doc_id") * 7 + 1).alias("ticker"), F.col("text").alias("key_risks"))
    return rounded(retrieval.cards(_hybrid(spark, d), p.join(risk, "ticker", "full")))


SQL["recommendation_card"] = rf"""WITH {_HYBRID}, k AS (SELECT doc_id * 7 + 1 AS ticker, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
SELECT g.query_id, g.ticker, g.name, round(g.final_score, 6) AS final_score, CASE WHEN p_size > 10 THEN p_brand ELSE '-' END AS benchmark, CASE WHEN k.t IS NULL OR k.t = '' THEN '-' WHEN length(k.t) > 200 THEN regexp_replace(left(k.t, 200), ' [^ ]*$', '') || '...' ELSE k.t END AS key_risks,
  CASE WHEN p_size % 2 = 0 THEN format('{{:.2f}}%', floor(p_retailprice) / 1000) ELSE '-' END AS fee, (SELECT string_agg(o.ticker || ' ' || o.name, ', ' ORDER BY rank) FROM g o WHERE o.query_id = g.query_id AND rank BETWEEN 2 AND 4) AS alternatives
FROM g LEFT JOIN part ON p_partkey = g.ticker LEFT JOIN k ON k.ticker = g.ticker WHERE g.rank = 1"""


_VARIED = "CASE turn % 5 WHEN 0 THEN 'Tell me about ' WHEN 2 THEN 'What is the fee risk of ' WHEN 4 THEN 'any news? ' ELSE '' END"


def _turns(spark, d):
    """User turns with a lead-in by position, so that every intent occurs."""
    lead = F.when(F.col("turn") % 5 == 0, "Tell me about ").when(F.col("turn") % 5 == 2, "What is the fee risk of ").when(F.col("turn") % 5 == 4, "any news? ").otherwise("")
    return read(spark, d, "conversations").withColumn("text", F.when(F.col("role") == "user", F.concat(lead, "text")).otherwise(F.col("text")))


_TURNS = f"t AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {_VARIED} || text ELSE text END AS text FROM conversations)"


@query
def intent_router(spark, d):
    t = _turns(spark, d).filter("role = 'user'")
    return t.select("conv_id", "turn", C.language(F.col("text")).alias("language"), C.intent(F.col("text")).alias("intent"), F.array_join(C.matching(F.col("text"), fixed.THEMES), ",").alias("themes"), C.contains_any(F.col("text"), fixed.INTENTS["recommendation"]).alias("asks_recommendation"))


def _themes_sql(table):
    return "array_to_string(list_sort([x FOR x IN [" + ", ".join(f"CASE WHEN {_any_sql('q', w)} THEN {_quote(k)} END" for k, w in table.items()) + "] IF x IS NOT NULL]), ',')"


_I = {k: _any_sql("q", v) for k, v in fixed.INTENTS.items()}
SQL["intent_router"] = rf"""WITH {_TURNS}, u AS (SELECT *, lower(text) AS q FROM t WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[\x{{4e00}}-\x{{9fff}}]') THEN 'zh' ELSE 'en' END AS language,
  CASE WHEN {_I['related']} THEN 'model1_related' WHEN {_I['news']} THEN 'model2_discovery' WHEN {_I['feature']} THEN 'etf_features' WHEN {_I['fee']} OR {_I['dividend']} OR {_I['tracking']} THEN 'factual' WHEN {_I['risk']} THEN 'risk_explain' ELSE 'general' END AS intent,
  {_themes_sql(fixed.THEMES)} AS themes, {_I['recommendation']} AS asks_recommendation FROM u"""


def _qa(spark, d):
    p = qa.question_pairs(_turns(spark, d))
    return p.select((F.col("conv_id") * 1000 + F.col("pos")).alias("pos"), F.when(F.col("question").endswith("?"), F.col("question")).otherwise(F.concat("question", F.lit("?"))).alias("question"), "answer", F.concat(F.lit("tag"), (F.col("conv_id") % 3).cast("string")).alias("tag"))


_QA = f"""{_TURNS}, qa AS (SELECT u.conv_id * 1000 + u.turn AS pos, CASE WHEN right(u.text, 1) = '?' THEN u.text ELSE u.text || '?' END AS question, a.text AS answer, 'tag' || (u.conv_id % 3) AS tag
  FROM t u JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""
_NORM = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query
def qa_dedup_shortest(spark, d):
    """Gates, then per question the first or a strictly shorter answer."""
    good = _qa(spark, d).filter(C.is_question(F.col("question")) & ~C.is_bad_answer(F.col("answer"), F.col("tag"))).withColumn("key", C.question_key(F.col("question")))
    return qa.shortest_answers(good, ["key"]).select("key", "pos", "question", "answer", "tag")


SQL["qa_dedup_shortest"] = rf"""WITH {_QA}, g AS (SELECT *, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS key, length({_NORM.format('answer')}) AS n, lower({_NORM.format('answer')}) AS a FROM qa
  WHERE regexp_matches(lower({_NORM.format('question')}), '^({"|".join(fixed.QUESTION_STARTS)})') AND right(trim(question), 1) = '?'),
h AS (SELECT * FROM g WHERE length(a) >= 35 AND NOT ({" OR ".join(f"regexp_matches(a, {_quote(p)})" for p in fixed.BAD_ANSWERS)})),
f AS (SELECT *, first_value(n) OVER (PARTITION BY key ORDER BY pos) AS n0, row_number() OVER (PARTITION BY key ORDER BY pos) AS i FROM h),
c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY (n >= 40 AND n < n0) DESC, CASE WHEN n >= 40 AND n < n0 THEN n END, pos) AS r FROM f)
SELECT key, pos, question, answer, tag FROM c WHERE r = 1"""


@query
def qa_global_dedup(spark, d):
    """First record of each question by (tag, pos), numbered anew."""
    q = _qa(spark, d).withColumn("key", C.question_key(F.col("question")))
    one = frames.keep_first(q, ["key"], F.col("tag"), F.col("pos"))
    return one.select("tag", "pos", "question").withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy("pos")))


SQL["qa_global_dedup"] = rf"""WITH {_QA}, r AS (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(question), '\s+', ' ', 'g')) ORDER BY tag, pos) AS i FROM qa)
SELECT tag, pos, question, CAST(row_number() OVER (PARTITION BY tag ORDER BY pos) AS INTEGER) AS rank FROM r WHERE i = 1"""


@query
def qa_fuzzy_lookup(spark, d):
    """Every user turn, asked again without its last word, against the whole questions of its ticker, an id modulo ten."""
    asked = _turns(spark, d).filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), (F.col("conv_id") % 10).alias("ticker"), F.regexp_replace("text", r"\s+\S+\s*$", "").alias("text"))
    known = qa.question_pairs(_turns(spark, d)).select((F.col("conv_id") * 1000 + F.col("pos")).alias("item"), (F.col("conv_id") % 10).alias("ticker"), "question", "answer", F.lit("en").alias("language"), F.concat(F.lit("tag"), F.col("conv_id") % 3).alias("tag"))
    return rounded(qa.fuzzy_lookup(asked, known))


@query
def feature_card(spark, d):
    """First answer of each tag per conversation group, pivoted."""
    q = _qa(spark, d).withColumn("g", F.floor(F.col("pos") / 10000))
    return q.groupBy("g").agg(*[F.min(F.when(F.col("tag") == t, F.struct("pos", "answer")))["answer"].alias(t) for t in ("tag0", "tag1", "tag2")])


SQL["feature_card"] = f"""WITH {_QA} SELECT CAST(floor(pos / 10000) AS BIGINT) AS g, arg_min(answer, pos) FILTER (WHERE tag = 'tag0') AS tag0, arg_min(answer, pos) FILTER (WHERE tag = 'tag1') AS tag1, arg_min(answer, pos) FILTER (WHERE tag = 'tag2') AS tag2 FROM qa GROUP BY 1"""


@query
def chatml_export(spark, d):
    r = qa.chatml(_qa(spark, d).withColumn("id", F.col("pos").cast("string")), "You answer from fund documents.", ["tag", "pos"])
    back = r.select("id", F.from_json("record", "messages array<struct<role:string,content:string>>, metadata struct<tag:string,pos:long>").alias("r"))
    return back.select("id", F.size("r.messages").alias("n"), F.array_join(F.transform("r.messages", lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])), "\n").alias("rendered"), "r.metadata.tag")


SQL["chatml_export"] = f"""WITH {_QA} SELECT CAST(pos AS VARCHAR) AS id, 3 AS n, 'SYSTEM: You answer from fund documents.' || chr(10) || 'USER: ' || question || chr(10) || 'ASSISTANT: ' || answer AS rendered, tag FROM qa"""


@query
def train_eval_split(spark, d):
    return qa.train_eval_split(_qa(spark, d).select("pos", "tag"), "pos").groupBy("split", "tag").agg(F.count("*").alias("n"))


SQL["train_eval_split"] = f"""WITH {_QA}, r AS (SELECT tag, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || pos), 1, 12) AS BIGINT), pos) AS i, count(*) OVER () AS n FROM qa)
SELECT CASE WHEN i <= greatest(1, CAST(floor(0.05::DOUBLE * n) AS BIGINT)) THEN 'eval' ELSE 'train' END AS split, tag, count(*) AS n FROM r GROUP BY 1, 2"""


@query
def fee_answer(spark, d):
    """First realistic percentage of each document."""
    return read(spark, d, "documents").select("doc_id", F.get(C.realistic_percents(F.col("text")), F.lit(0)).alias("fee"))


SQL["fee_answer"] = r"""WITH p AS (SELECT doc_id, [TRY_CAST(x AS DOUBLE) FOR x IN regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*%', 1)] AS xs FROM documents)
SELECT doc_id, list_filter(xs, lambda x: x > 0 AND x <= 5)[1] AS fee FROM p"""


@query
def metadata_suggest(spark, d):
    """Best five parts for each user turn by token overlap with their metadata, those with any."""
    asked = _turns(spark, d).filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("item"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    return rounded(retrieval.lexical(asked, rows, 5))


SQL["metadata_suggest"] = rf"""WITH {_TURNS}, q AS (SELECT conv_id * 1000 + turn AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{{4e00}}-\x{{9fff}}]+')) AS ts FROM t WHERE role = 'user'),
m AS (SELECT p_partkey AS item, unnest(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_brand || ' ' || p_type), '[a-z0-9\x{{4e00}}-\x{{9fff}}]+'))) AS t FROM part),
h AS (SELECT query_id, item, count(*) / any_value(n) AS overlap FROM (SELECT query_id, len(ts) AS n, unnest(ts) AS t FROM q) JOIN m USING (t) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, item) AS rank FROM h)
SELECT query_id, item, round(overlap, 6) AS overlap, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5"""


@query
def risk_candidates(spark, d):
    """Three best rows with a positive score for every query row."""
    return rounded(retrieval.candidates(_queries(spark, d), _corpus(spark, d)))


SQL["risk_candidates"] = f"WITH {_DOT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM p) SELECT query_id, item, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3 AND score > 0"


@query
def risk_corpus(spark, d):
    """First text of each source's code; the code is a source's length, blank texts go."""
    docs = read(spark, d, "documents").select("doc_id", F.length("source").cast("string").alias("ticker"), F.col("text").alias("profile_text"))
    return retrieval.risk_corpus(docs, "ticker", order="doc_id")


SQL["risk_corpus"] = """WITH c AS (SELECT doc_id, lpad(length(source)::VARCHAR, 4, '0') AS code, trim(text, ' ') AS risk_text FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY doc_id) AS i FROM c WHERE risk_text <> '' AND code <> '0000') SELECT code, risk_text FROM r WHERE i = 1"""


@query
def qa_language_counts(spark, d):
    """Pairs by language, tickers with any, and tickers without."""
    p = qa.question_pairs(_turns(spark, d)).withColumn("zh", C.language(F.col("question")) == "zh")
    all_ = read(spark, d, "conversations").agg(F.count_distinct("conv_id").alias("tickers"))
    got = p.agg(F.count("*").alias("pairs"), F.count(F.when(F.col("zh"), 1)).alias("zh"), F.count(F.when(~F.col("zh"), 1)).alias("en"), F.count_distinct("conv_id").alias("with_pairs"))
    return got.join(F.broadcast(all_)).withColumn("failed", F.col("tickers") - F.col("with_pairs"))


SQL["qa_language_counts"] = rf"""WITH {_TURNS}, p AS (SELECT u.conv_id, regexp_matches(u.text, '[\x{{4e00}}-\x{{9fff}}]') AS zh FROM t u JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
g AS (SELECT count(*) AS pairs, count(*) FILTER (WHERE zh) AS zh, count(*) FILTER (WHERE NOT zh) AS en, count(DISTINCT conv_id) AS with_pairs FROM p)
SELECT *, tickers - with_pairs AS failed FROM g, (SELECT count(DISTINCT conv_id) AS tickers FROM conversations)"""


@query
def ticker_resolution(spark, d):
    """The whole cascade for every whole user turn, some of them led by words that call for a rule: code, name, sure and moderate hybrid rank, suggestions. Instruments are all nations, a code each from 0001: code 0000 is none."""
    lead = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("code 9999 and "), F.lpad((F.col("conv_id") % 25).cast("string"), 4, "0"), F.lit(" "))).when(F.col("conv_id") % 5 == 1, "buy GERMANY now ").when(F.col("conv_id") % 5 == 2, "oil ").when(F.col("conv_id") % 5 == 3, "dividend income and oil of europe ").otherwise("")
    text = F.concat(lead, "text")
    asked = frames.materialise(read(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), text.alias("text")))
    geo = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = geo.select(F.lpad((F.col("n_nationkey") + 1).cast("string"), 4, "0").alias("ticker"), F.col("n_name").alias("name"), F.concat_ws(" ", "n_name", "r_name", F.when(F.col("n_nationkey") == 7, "oil dividend")).alias("bundle"))
    nothing = asked.select("query_id", F.lit("").alias("ticker"), F.lit(0.0).alias("score")).filter("false")
    ranked = retrieval.hybrid(asked, nations, nothing, nations.select("ticker", F.lit("").alias("text"), F.lit(0.0).alias("score")).filter("false"), 3)
    hints = retrieval.lexical(asked, nations.select(F.col("ticker").cast("long").alias("item"), F.col("bundle").alias("text")), 3).select("query_id", F.lpad(F.col("item").cast("string"), 4, "0").alias("ticker"), "rank")
    return retrieval.resolve_codes(asked, nations, ranked, hints)


SQL["ticker_resolution"] = rf"""WITH a AS (SELECT conv_id * 1000 + turn AS query_id, CASE conv_id % 5 WHEN 0 THEN 'code 9999 and ' || lpad((conv_id % 25)::VARCHAR, 4, '0') || ' ' || text WHEN 1 THEN 'buy GERMANY now ' || text WHEN 2 THEN 'oil ' || text
  WHEN 3 THEN 'dividend income and oil of europe ' || text ELSE text END AS text FROM conversations WHERE role = 'user'),
n AS (SELECT lpad((n_nationkey + 1)::VARCHAR, 4, '0') AS ticker, lower(n_name) AS name, lower(n_name || ' ' || r_name || CASE WHEN n_nationkey = 7 THEN ' oil dividend' ELSE '' END) AS low FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT query_id, {_WORDS} AS qt, {_has_themes(fixed.THEMES)} AS qth, low FROM (SELECT query_id, lower(trim(text, ' ')) AS low FROM a)),
m AS (SELECT ticker, name, {_WORDS} AS mt, {_has_themes(fixed.BUNDLE_THEMES)} AS mth FROM n),
c AS (SELECT query_id, first(h ORDER BY o) AS t1 FROM (SELECT query_id, unnest(hs) AS h, unnest(range(len(hs))) AS o FROM (SELECT query_id, regexp_extract_all(text, '\b(\d{{4}})\b', 1) AS hs FROM a)) WHERE h IN (SELECT ticker FROM n) GROUP BY 1),
w AS (SELECT query_id, min(ticker) AS t2 FROM q JOIN m ON contains(low, name) OR contains(name, low) WHERE low <> '' GROUP BY 1),
s AS (SELECT query_id, ticker, len(list_intersect(qt, mt)) / greatest(len(qt), 1) AS o, round(0.40::DOUBLE * len(list_intersect(qth, mth)) / greatest(len(qth), 1) + 0.30::DOUBLE * len(list_intersect(qt, mt)) / greatest(len(qt), 1), 9) AS f FROM q, m),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, ticker) AS i, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, ticker) AS l FROM s),
g AS (SELECT query_id, max(ticker) FILTER (WHERE i = 1) AS t3, max(f) FILTER (WHERE i = 1) AS s1, max(f) FILTER (WHERE i = 2) AS s2, coalesce(string_agg(ticker, ',' ORDER BY l) FILTER (WHERE l <= 3 AND o > 0), '') AS hint FROM r GROUP BY 1),
x AS (SELECT *, CASE WHEN t1 IS NOT NULL THEN 1 WHEN t2 IS NOT NULL THEN 2 WHEN s1 >= 0.20 AND s1 - s2 >= 0.03 THEN 3 WHEN s1 >= 0.16 THEN 4 ELSE 5 END AS rule FROM q JOIN g USING (query_id) LEFT JOIN c USING (query_id) LEFT JOIN w USING (query_id))
SELECT query_id, rule, CASE rule WHEN 1 THEN t1 WHEN 2 THEN t2 WHEN 5 THEN NULL ELSE t3 END AS ticker, CASE WHEN rule = 5 THEN hint END AS suggestions FROM x"""


@query
def risk_bullets(spark, d):
    """Up to three answers about risks for every whole user turn, by token overlap with the recorded questions."""
    p = qa.question_pairs(_turns(spark, d)).select((F.col("conv_id") * 1000 + F.col("pos")).alias("item"), "question", "answer", F.concat(F.lit("tag"), F.col("conv_id") % 3).alias("tag"))
    asked = read(spark, d, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.lit("what is the fee risk of "), "text").alias("text"))
    scored = retrieval.lexical(asked, p.select("item", F.col("question").alias("text")), 8).withColumnRenamed("overlap", "score").drop("rank")
    return qa.risk_bullets(scored.join(p, "item"))


SQL["risk_bullets"] = rf"""WITH {_TURNS}, p AS (SELECT u.conv_id * 1000 + u.turn AS item, u.text AS question, a.text AS answer FROM t u JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
q AS (SELECT query_id, {_WORDS} AS qt FROM (SELECT conv_id * 1000 + turn AS query_id, lower('what is the fee risk of ' || text) AS low FROM conversations WHERE role = 'user')),
k AS (SELECT item, unnest({_WORDS}) AS t FROM (SELECT item, lower(question) AS low FROM p)),
h AS (SELECT query_id, item, count(*) / any_value(n) AS score FROM (SELECT query_id, len(qt) AS n, unnest(qt) AS t FROM q) JOIN k USING (t) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS i FROM h QUALIFY i <= 8),
s AS (SELECT query_id, item, i, trim(regexp_replace(answer, '\s+', ' ', 'g'), ' .;,:') AS x FROM r JOIN p USING (item) WHERE score >= 0.30 AND {_any_sql('lower(question)', fixed.LOOKUP_WORDS['risk'])} AND NOT {_any_sql('lower(answer)', fixed.LEGAL_FRAGMENTS)}),
v AS (SELECT query_id, item, i, CASE WHEN length(x) > 220 THEN regexp_replace(left(x, 220), ' [^ ]*$', '') ELSE x END || '.' AS text FROM s WHERE x <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) ORDER BY i) AS j FROM v),
b AS (SELECT query_id, item, text, row_number() OVER (PARTITION BY query_id ORDER BY i) AS bullet FROM o WHERE j = 1)
SELECT query_id, CAST(bullet AS INTEGER) AS bullet, item, text FROM b WHERE bullet <= 3"""


@query
def fee_reply(spark, d):
    """Reply about the charges of each document in the language of its text."""
    t = read(spark, d, "documents").select("doc_id", "text", "lang")
    return t.select("doc_id", replies.fee_reply(F.when(F.col("lang") == "en", "en").otherwise("zh"), F.coalesce(F.get(C.realistic_percents(F.col("text")), F.lit(0)), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 41 / 8))).alias("reply"))


SQL["fee_reply"] = rf"""WITH p AS (SELECT doc_id, lang, [TRY_CAST(x AS DOUBLE) FOR x IN regexp_extract_all(text, '(\d+(?:\.\d+)?)\s*%', 1)] AS xs FROM documents),
f AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'zh' END AS lang, coalesce(list_filter(xs, lambda x: x > 0 AND x <= 5)[1], CASE WHEN doc_id % 3 = 0 THEN (doc_id % 41) / 8 END) AS fee FROM p),
t AS (SELECT *, regexp_replace(printf('%.3f', fee), '\.?0+$', '') AS n FROM f)
SELECT doc_id, CASE WHEN lang = 'en' AND fee IS NULL THEN {_quote(fixed.FEE_REPLIES['en'][1])} WHEN lang = 'en' THEN replace({_quote(fixed.FEE_REPLIES['en'][0])}, '{{}}', n) WHEN fee IS NULL THEN {_quote(fixed.FEE_REPLIES['zh'][1])} ELSE replace({_quote(fixed.FEE_REPLIES['zh'][0])}, '{{}}', n) END AS reply FROM t"""


@query
def question_gates(spark, d):
    """English and Chinese question gates over whole user turns, and which are too noisy for an answer."""
    chinese = F.col("conv_id") % 2 == 1
    asked = F.concat("text", F.when(chinese, "？").otherwise("?"))
    t = _turns(spark, d).filter("role = 'user'")
    return t.select("conv_id", "turn", C.is_question(asked, F.when(chinese, "zh-HK").otherwise("en")).alias("asks"), C.is_noisy_sentence(F.col("text")).alias("noisy"), C.compact_answer(F.col("text"), 300).alias("answer"))


SQL["question_gates"] = rf"""WITH {_TURNS}, f AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM t WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 1 THEN NOT ({" OR ".join(f"starts_with(lower(s), {_quote(x)})" for x in fixed.CHINESE_INSTRUCTIONS)}) ELSE regexp_matches(lower(s), {_quote("^(" + "|".join(fixed.QUESTION_STARTS) + ")")}) END AS asks,
  length(s) < 25 OR {" OR ".join(f"regexp_matches(lower(s), {_quote(p)})" for p in fixed.NOISY_SENTENCES)} AS noisy, trim(left(replace(replace(s, ' ,', ','), ' .', '.'), 300)) AS answer FROM f"""


@query
def topic_answers(spark, d):
    """Two to four sentences for each question of a topic, by source; sentences are whole texts led in by a topic's word."""
    return qa.topic_answers(_topic_lines(spark, d), "source").select("source", "topic", "n", "question", "answer")


_TOPIC_WORDS = ["The strategy is ", "Tracking error of ", "Fees are ", "Futures on ", "Termination of ", "A dividend of ", "Dual counter of "]


def _topic_lines(spark, d):
    lead = F.get(F.array(*[F.lit(x) for x in _TOPIC_WORDS]), (F.col("doc_id") % len(_TOPIC_WORDS)).cast("int"))
    return read(spark, d, "documents").select("source", F.col("doc_id").alias("pos"), F.concat(lead, C.squeezed(F.col("text"))).alias("text"))


_HEX = " + ".join(f"(strpos('0123456789abcdef', substr(md5(h), {i}, 1)) - 1) * {16 ** (4 - i)}" for i in range(1, 5))
SQL["topic_answers"] = rf"""WITH l AS (SELECT source, doc_id AS pos, CASE doc_id % 7 {" ".join(f"WHEN {i} THEN {_quote(x)}" for i, x in enumerate(_TOPIC_WORDS))} END || trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents),
p AS ({" UNION ALL ".join(f"SELECT source, pos, text, {_quote(t)} AS topic FROM l WHERE regexp_matches(lower(text), {_quote(x)})" for t, x in fixed.TOPIC_PATTERNS.items())}),
r AS (SELECT *, row_number() OVER (PARTITION BY source, topic ORDER BY pos) AS i, count(*) OVER (PARTITION BY source, topic) AS c FROM p QUALIFY i <= 8),
k AS ({" UNION ALL ".join(f"SELECT {_quote(t)} AS topic, {i} AS n, {_quote(q)} AS ask" for t, qs in fixed.TOPIC_QUESTIONS.items() for i, q in enumerate(qs))}),
j AS (SELECT source, r.topic, n, replace(ask, '{{}}', source) AS question, '42:' || replace(ask, '{{}}', source) AS h, text, c FROM r JOIN k ON k.topic = r.topic),
o AS (SELECT *, row_number() OVER (PARTITION BY source, topic, n ORDER BY md5(h || ':' || text), text) AS i, 2 + ({_HEX}) % 3 AS take FROM j),
a AS (SELECT source, topic, n, question, string_agg(text, ' ' ORDER BY i) AS t FROM o WHERE i <= take GROUP BY ALL)
SELECT source, topic, CAST(n AS INTEGER) AS n, question, trim(left(replace(replace(trim(regexp_replace(t, '\s+', ' ', 'g')), ' ,', ','), ' .', '.'), 900)) AS answer FROM a"""


@query
def summary_card(spark, d):
    """Lookup card per supplier: benchmark, risk text cut at a word, fee, missing pieces as "-"."""
    s = read(spark, d, "supplier").join(F.broadcast(read(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    risk = frames.keep_first(read(spark, d, "documents").filter("lang = 'en'").select((F.col("doc_id") % 150).alias("s_suppkey"), "doc_id", "text"), ["s_suppkey"], F.col("doc_id"))
    j = s.join(risk, "s_suppkey", "left")
    return j.select("s_suppkey", F.coalesce("n_name", F.lit("-")).alias("geo"), F.coalesce(F.substring("text", 1, 200), F.lit("-")).alias("risks"), C.percent(F.when(F.col("s_acctbal") > 0, F.floor(F.col("s_acctbal") / 100) / 10.0)).alias("fee"))


SQL["summary_card"] = """WITH r AS (SELECT doc_id % 150 AS s_suppkey, arg_min(text, doc_id) AS text FROM documents WHERE lang = 'en' GROUP BY 1)
SELECT s_suppkey, coalesce(n_name, '-') AS geo, coalesce(left(text, 200), '-') AS risks, CASE WHEN s_acctbal > 0 THEN format('{:.2f}%', floor(s_acctbal / 100) / 10.0::DOUBLE) ELSE '-' END AS fee FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN r USING (s_suppkey)"""


@query
def embedding_text(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", replies.embedding_text(F.col("p_partkey"), F.col("p_brand"), F.when(F.col("p_size") > 10, F.col("p_type")), F.when(F.col("p_size") > 30, F.lit("nan")).otherwise("Asia"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.col("p_name")).alias("text"))


SQL["embedding_text"] = r"""SELECT p_partkey, concat_ws(' ', 'Ticker ' || CASE WHEN p_partkey < 100000 THEN lpad(p_partkey::VARCHAR, 5, '0') ELSE p_partkey::VARCHAR END || '.', 'Benchmark ' || p_brand || '.',
  CASE WHEN p_size > 10 THEN 'Asset class ' || p_type || '.' END, CASE WHEN p_size <= 30 THEN 'Geographic focus Asia.' END, CASE WHEN p_size % 2 = 0 THEN 'Risk summary: ' || p_name ELSE left(p_name, 900) END) AS text FROM part"""


@query
def chinese_questions(spark, d):
    """Bilingual expansion of every user turn by the first fitting beginning; beginnings are dealt by conversation and turn."""
    n = (F.col("conv_id") + F.col("turn")) % (len(fixed.CHINESE_QUESTIONS) + 1)
    q = F.concat(F.get(F.array(*[F.lit(a) for a, _ in fixed.CHINESE_QUESTIONS], F.lit("Tell me")), n.cast("int")), F.lit(" "), "text")
    t = read(spark, d, "conversations").filter("role = 'user'")
    return t.select("conv_id", "turn", q.alias("question"), replies.chinese_question(q, F.lpad(F.col("conv_id").cast("string"), 6, "0")).alias("zh")).filter("zh is not null")


_ZH = "[" + ", ".join(_quote(a) for a, _ in fixed.CHINESE_QUESTIONS) + ", 'Tell me']"
SQL["chinese_questions"] = f"""WITH q AS (SELECT conv_id, turn, (SELECT {_ZH})[1 + (conv_id + turn) % {len(fixed.CHINESE_QUESTIONS) + 1}] || ' ' || text AS question FROM conversations WHERE role = 'user'),
z AS (SELECT *, CASE {' '.join(f'WHEN starts_with(question, {_quote(a)}) THEN {_quote(b)}' for a, b in fixed.CHINESE_QUESTIONS)} END AS t FROM q)
SELECT conv_id, turn, question, t || '（' || lpad(conv_id::VARCHAR, 6, '0') || '）？' AS zh FROM z WHERE t IS NOT NULL"""


@query
def fallback_replies(spark, d):
    """Replies of user turns without a model, and prompts' intent rules."""
    t = _turns(spark, d).filter("role = 'user'")
    q = F.concat("text", F.when(F.col("conv_id") % 3 == 0, " recommend one").otherwise(""))
    return t.select("conv_id", "turn", replies.fallback(q, F.col("conv_id"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("0001"), F.lit("0002"))).otherwise(F.array().cast("array<string>"))).alias("reply"))


SQL["fallback_replies"] = rf"""WITH {_TURNS}, u AS (SELECT conv_id, turn, lower(text || CASE WHEN conv_id % 3 = 0 THEN ' recommend one' ELSE '' END) AS q,
  'You asked about ' || CASE WHEN conv_id < 10000 THEN lpad(conv_id::VARCHAR, 4, '0') ELSE conv_id::VARCHAR END || '. Confirm the exact benchmark in the fund name and the official key facts statement.' AS base FROM t WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN {_I['recommendation']} AND conv_id % 2 = 0 THEN base || ' You can review: 0001, 0002.' WHEN {_I['risk']} THEN base || ' Check market volatility, concentration and tracking error.' ELSE base END AS reply FROM u"""
