"""Two-stage retrieval over embedding columns, its evaluation, and lexical search through an inverted index."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestream.frames import keep_first, materialise, top_n
from lodestream.functions import columns as C
from lodestream.operators import overlap, vectors

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Preset:
    """Weights of one retrieval mode; encoders are outside and come in as columns."""

    multiplier: int = 4
    cross_top: int = 0
    cross_weight: float = 0.12
    ticker_weight: float = 0.35
    metadata_weight: float = 0.10
    tag_weight: float = 0.10


FAST = Preset()
QUALITY = Preset(6, 24, 0.20, 0.35, 0.12, 0.12)


def boost(text: Column, code: Column, metadata: Column, tags: Column, p: Preset = FAST) -> Column:
    """Code in the text (padded or as a number), metadata values of 4 or more characters, tags; all as substrings."""
    t = F.lower(text)
    hits = lambda xs: F.size(F.filter(xs, lambda x: t.contains(x)))
    named = F.when(t.contains(code) | t.contains(code.try_cast("bigint").cast("string")), p.ticker_weight).otherwise(0.0)
    values = F.filter(F.transform(metadata, lambda m: F.lower(F.trim(m))), lambda m: (F.length(m) >= 4) & (m != "nan"))
    words = F.filter(F.transform(tags, lambda g: F.replace(F.trim(g), F.lit("_"), F.lit(" "))), lambda g: g != "")
    return named + p.metadata_weight * hits(values) + p.tag_weight * hits(words)


def similar(queries: DataFrame, corpus: DataFrame, k: int, **how) -> DataFrame:
    """(query_id, item, score, rank): exact top k by dot product, ties to the smaller item; see ``vectors.nearest``."""
    return vectors.nearest(queries, corpus, k, **how)


def rerank(candidates: DataFrame, k: int, preset: Preset = FAST) -> DataFrame:
    """(query_id, item, score, boost, cross) to the final top k: bi-encoder + boost + weight * sigmoid(cross) for the
    first ``cross_top`` candidates; what is not finite counts 0."""
    finite = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item"))
    crossed = F.when((first <= preset.cross_top) & F.col("cross").isNotNull(), preset.cross_weight * C.sigmoid(F.col("cross"))).otherwise(0.0)
    final = candidates.withColumn("final_score", finite(finite(F.col("score")) + finite(F.col("boost")) + crossed))
    return top_n(final, ["query_id"], k, F.col("final_score").desc(), F.col("item"))


def evaluate(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, item) against (query_id, item): top-1 precision and top-k hit rate over labelled queries, null
    without any."""
    hits = ranked.join(gold.withColumn("gold", F.lit(1)), ["query_id", "item"], "left")
    by = hits.groupBy("query_id").agg(F.max(F.when((F.col("rank") == 1) & (F.col("gold") == 1), 1).otherwise(0)).alias("top1"), F.max(F.when((F.col("rank") <= k) & (F.col("gold") == 1), 1).otherwise(0)).alias("hit"))
    labelled = by.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    return labelled.agg(F.count("*").alias("labelled"), F.avg("top1").alias("top1_precision"), F.avg("hit").alias("topk_recall"))


def latencies(runs: DataFrame) -> DataFrame:
    """``runs`` (ms) to mean and the element at max(int(0.95 n) - 1, 0) of the sorted values, not an interpolated one."""
    r = runs.agg(F.avg("ms").alias("latency_avg"), F.array_sort(F.collect_list("ms")).alias("s"))
    return r.select("latency_avg", F.get("s", F.greatest(F.floor(F.size("s") * 0.95).cast("int") - 1, F.lit(0))).alias("latency_p95"))


def _lexical(asked: list[tuple[int, str, int]], k: int):
    ids, sizes = (np.array([x[c] for x in asked], dtype=np.int64) for c in (0, 2))
    texts = [x[1] for x in asked]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for f in frames:
            new = overlap.best_shared(ids, texts, sizes, f["item"], f["ws"].tolist(), k)
            best = new if best is None else pd.concat([best, new])
            best = best.sort_values(["query_id", "overlap", "item"], ascending=[True, False, True], na_position="first").groupby("query_id").head(k)
        if best is not None:
            yield best.astype({"item": "Int64"})

    return work


def lexical(queries: DataFrame, rows: DataFrame, k: int, most_tokens: int = 200_000) -> DataFrame:
    """Top k rows a query by the share of its tokens they hold. ``queries`` (query_id, text), ``rows`` (item, text).

    Words shared are counted for slices of queries and rows, see ``overlap.shared``. A batch of up to ``most_tokens`` query
    tokens is sent to the rows; beyond, blocks of queries meet blocks of rows. Either way each task hands on k rows a query and
    no pairs travel.
    """
    words = F.array_join("ts", " ").alias("ws")
    q = queries.select(F.col("query_id").cast("long"), C.tokens(F.col("text")).alias("ts")).filter("ts is not null").select("query_id", words, F.size("ts").cast("long").alias("n"))
    r = rows.select(F.col("item").cast("long"), C.tokens(F.col("text")).alias("ts")).filter("size(ts) > 0").select("item", words)
    schema = "query_id long, item long, overlap double"
    if (q.agg(F.sum("n").alias("n")).first()["n"] or 0) <= most_tokens:
        hit = r.mapInPandas(_lexical([tuple(x) for x in q.filter("query_id is not null").collect()], k), schema)
    else:
        block = lambda a, b: overlap.best_shared(a["query_id"].to_numpy(), a["ws"].tolist(), a["n"].to_numpy(), b["item"], b["ws"].tolist(), k).astype({"item": "Int64"})
        hit = overlap.in_blocks(q.filter("query_id is not null"), r, block, schema)
    return top_n(hit, ["query_id"], k, F.col("overlap").desc(), F.col("item"))


def risk_corpus(profiles: DataFrame, code: str, text_columns: tuple[str, ...] = ("key_risks", "profile_text"), order: str | None = None) -> DataFrame:
    """(code, risk_text): the first of ``text_columns`` that the table has; blank texts and code 0000 go, the first row of
    a code stays."""
    text = next(c for c in text_columns if c in profiles.columns)
    d = profiles.select(C.digits_code(F.col(code)).alias("code"), F.trim(F.col(text)).alias("risk_text"), F.col(order or code).alias("o"))
    return keep_first(d.filter("risk_text <> '' and code <> '' and code <> '0000'"), ["code"], F.col("o")).drop("o")


def candidates(queries: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """Best ``k`` codes a query with a positive score: by vectors where both sides have them (q; v), else by tokens."""
    if "q" in queries.columns and "v" in corpus.columns:
        return similar(queries.select("query_id", "q"), corpus.select("item", "v"), k).filter("score > 0")
    return lexical(queries, corpus, k).withColumnRenamed("overlap", "score")


def meet(queries: DataFrame, rows: DataFrame, query: str, row: str, query_block: int = 512, block: int = 4096) -> DataFrame:
    """Every query beside every row, in pairs of blocks of bounded size, for scores that built-ins express. Rows of a null
    id meet as those of one block."""
    nq, nc = (max(1, -(-df.count() // n)) for df, n in ((queries, query_block), (rows, block)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("*", part(query, nq).alias("_qb"), spread(nc).alias("_cb"))
    return q.join(rows.select("*", part(row, nc).alias("_cb"), spread(nq).alias("_qb")), ["_qb", "_cb"]).drop("_qb", "_cb")


def hybrid(queries: DataFrame, catalogue: DataFrame, risks: DataFrame, news: DataFrame, k: int = 5, most_risks: int = 30) -> DataFrame:
    """Best ``k`` instruments of each query by .40 theme + .30 metadata + .25 risk / the query's best risk + .05 news.

    ``queries`` (query_id, text), ``catalogue`` (ticker, name, bundle) with one row a ticker, ``risks`` (query_id, ticker,
    score), of which the ``most_risks`` best positive ones of a query count, ``news`` (ticker, text, score), of which a ticker's
    best .6 overlap + .4 score counts; negative scores of news are 0. All of the catalogue and whatever has a risk score
    is ranked, ties by ticker. Risk and news only add, so that what has neither is among the first k by metadata alone: no
    more of the pairs than these travel.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    q = queries.select("query_id", C.tokens(text("text")).alias("qt"), C.matching(text("text"), C.fixed.THEMES).alias("qth"))
    m = catalogue.select("ticker", "name", C.tokens(text("bundle")).alias("mt"), C.matching(text("bundle"), C.fixed.BUNDLE_THEMES).alias("mth"))
    said = news.groupBy("ticker", F.array_sort(C.tokens(text("text"))).alias("nt")).agg(F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.0)).alias("ns"))
    # Only words that a bundle or news has can be shared: the others count in a query's size and need not meet anything.
    known = m.select(F.explode("mt").alias("t")).union(said.select(F.explode("nt"))).distinct()
    kept = q.select("query_id", F.explode("qt").alias("t")).join(known, "t", "left_semi").groupBy("query_id").agg(F.collect_set("t").alias("kt"))
    q = materialise(q.join(kept, "query_id", "left").select("query_id", "qth", F.size("qt").alias("n"), F.coalesce("kt", F.array().cast("array<string>")).alias("qt")))
    share = lambda row: F.size(F.array_intersect("qt", row)) / F.greatest("n", F.lit(1))
    meta = share("mt")
    theme = F.size(F.array_intersect("qth", "mth")) / F.greatest(F.size("qth"), F.lit(1))
    plain = top_n(meet(q, m, "query_id", "ticker").select("query_id", "ticker", (0.4 * theme + 0.3 * meta).alias("s")), ["query_id"], k, F.col("s").desc(), F.col("ticker"))
    risk = top_n(risks.filter("score > 0"), ["query_id"], most_risks, F.col("score").desc(), F.col("ticker")).select("query_id", "ticker", F.col("score").alias("risk_score"))
    best = risk.groupBy("query_id").agg(F.max("risk_score").alias("best_risk"))
    told = meet(q.filter("n > 0"), said, "query_id", "ticker")
    aux = told.groupBy("query_id", "ticker").agg(F.max(0.6 * share("nt") + 0.4 * F.col("ns")).alias("news_score"))
    names = lambda df: df.select("query_id", "ticker")
    some = names(plain).union(names(risk)).union(names(aux).join(m.select("ticker"), "ticker", "left_semi").select("query_id", "ticker")).distinct()
    j = some.join(q, "query_id").join(m, "ticker", "left").join(risk, ["query_id", "ticker"], "left").join(best, "query_id", "left").join(aux, ["query_id", "ticker"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    j = j.select("query_id", "ticker", F.coalesce("name", F.lit("Unknown ETF")).alias("name"), zero(theme).alias("theme_score"), zero(meta).alias("metadata_score"), zero(F.col("risk_score")).alias("risk_score"), zero(F.col("news_score")).alias("news_score"), zero(F.col("risk_score") / F.greatest("best_risk", F.lit(1e-6))).alias("_n"))
    final = 0.40 * F.col("theme_score") + 0.30 * F.col("metadata_score") + 0.25 * F.col("_n") + 0.05 * F.col("news_score")
    return top_n(j.withColumn("final_score", F.round(final, 9)).drop("_n"), ["query_id"], k, F.col("final_score").desc(), F.col("ticker"))


def resolve_codes(queries: DataFrame, catalogue: DataFrame, ranked: DataFrame, suggested: DataFrame) -> DataFrame:
    """(query_id, rule, ticker, suggestions): the first rule that hits. 1: the first four-digit code of the text that is in
    the catalogue; 2: a name in the text or around it, the first by ticker; 3: the best of ``ranked`` with .20 or more and .03
    before the next; 4: the best with .16 or more; 5: none, with the ``suggested`` tickers (query_id, ticker, rank).

    ``queries`` (query_id, text), ``catalogue`` (ticker, name); code 0000 and blank names and texts hit nothing.
    """
    c = catalogue.select(F.col("ticker").cast("string").alias("ticker"), F.lower(F.trim("name")).alias("name")).filter("ticker <> '0000'")
    code = F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\p{N}_])(\d{4})(?![\p{L}\p{N}_])"), F.lit(1))
    hits = queries.select("query_id", F.posexplode(code).alias("o", "ticker")).join(c.select("ticker"), "ticker", "left_semi")
    first = hits.groupBy("query_id").agg(F.min(F.struct("o", "ticker"))["ticker"].alias("t1"))
    asked = queries.select("query_id", F.lower(F.trim("text")).alias("asked")).filter("asked <> ''")
    near = meet(asked, c.filter("name <> ''"), "query_id", "ticker").filter(F.col("asked").contains(F.col("name")) | F.col("name").contains(F.col("asked")))
    named = near.groupBy("query_id").agg(F.min("ticker").alias("t2"))
    top = ranked.groupBy("query_id").agg(*[F.max(F.when(F.col("rank") == r, F.col(v).cast(t))).alias(n) for r, v, t, n in ((1, "ticker", "string", "t3"), (1, "final_score", "double", "s1"), (2, "final_score", "double", "s2"))])
    hint = suggested.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col("ticker").cast("string").alias("t")))), lambda x: x["t"]), ",").alias("hint"))
    j = queries.select("query_id").join(first, "query_id", "left").join(named, "query_id", "left").join(top, "query_id", "left").join(hint, "query_id", "left")
    sure = (F.col("s1") >= 0.20) & (F.col("s1") - F.coalesce("s2", F.lit(0.0)) >= 0.03)
    rule = F.when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(sure, 3).when(F.col("s1") >= 0.16, 4).otherwise(5)
    j = j.withColumn("rule", rule)
    ticker = F.when(F.col("rule") == 1, F.col("t1")).when(F.col("rule") == 2, F.col("t2")).when(F.col("rule") < 5, F.col("t3"))
    return j.select("query_id", "rule", ticker.alias("ticker"), F.when(F.col("rule") == 5, F.coalesce("hint", F.lit(""))).alias("suggestions"))


def cards(ranked: DataFrame, details: DataFrame) -> DataFrame:
    """One row a query of ``ranked``: the best instrument with benchmark, risks cut at 200 characters, fee and up to three
    alternatives. ``details`` (ticker, benchmark, key_risks, fee), one row a ticker; missing pieces are "-"."""
    known = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("nan"))
    other = F.array_sort(F.collect_list(F.when(F.col("rank").between(2, 4), F.struct("rank", F.concat_ws(" ", "ticker", "name").alias("t")))))
    g = ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.struct("ticker", "name", "final_score"))).alias("b"), F.array_join(F.transform(other, lambda x: x["t"]), ", ").alias("alternatives"))
    j = g.select("query_id", "b.*", "alternatives").join(details, "ticker", "left")
    return j.select("query_id", "ticker", "name", "final_score", F.coalesce(known(F.col("benchmark")), F.lit("-")).alias("benchmark"), F.coalesce(C.cut_words(known(F.col("key_risks")), 200), F.lit("-")).alias("key_risks"), C.percent(F.col("fee")).alias("fee"), F.when(F.col("alternatives") == "", "No close alternatives found").otherwise(F.col("alternatives")).alias("alternatives"))
