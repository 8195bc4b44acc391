"""Replies from stored answers, in batches: shortened and plain answers, fees, risks, feature cards, related news.

Defined results: a null or blank answer is an empty text and takes part nowhere; a null tag or language matches none; rows
of a null ticker are a ticker of their own in ``fees`` and meet no question elsewhere; ties go to the smaller position.
"""

from __future__ import annotations

import sys
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.frames import top_n
from lodestream.functions import columns as C
from lodestream.functions import fixed
from lodestream.operators import overlap

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _cut_at_sentence(t: Column, most: int, least: int, ends: str, more: str = "") -> Column:
    """At most ``most`` characters: up to the last sentence end if it keeps more than ``least`` + 1, else whole words."""
    head = F.substring(t, 1, most)
    sentences = F.rtrim(F.regexp_extract(head, f"^(.*(?:{ends}))", 1))
    words = F.concat(F.trim(F.regexp_replace(head, " [^ ]*$", "")), F.lit(more))
    return F.when(F.length(t) <= most, t).when(F.length(sentences) > least + 1, sentences).otherwise(words)


def concise(answer: Column, most: int = 420) -> Column:
    """The first two sentences without the Chinese lead, at most ``most`` characters."""
    t = C.squeezed(F.coalesce(answer, F.lit("")))
    t = F.regexp_replace(t, fixed.ANSWER_LEAD, "")
    chunks = F.filter(F.split(F.regexp_replace(t, r"([.!?。！？])\s+", "$1\n"), "\n"), lambda x: F.trim(x) != "")
    two = F.trim(F.array_join(F.transform(F.slice(chunks, 1, 2), lambda x: F.trim(x)), " "))
    return _cut_at_sentence(two, most, 120, "[.!?] |。")


def plain(answer: Column, zh: Column, most: int = 240) -> Column:
    """Without legal boilerplate and torn ends, with the words of an investor, at most ``most`` characters."""
    t = reduce(lambda a, p: F.regexp_replace(a, f"(?i){p}", ""), fixed.BOILERPLATE, C.squeezed(F.coalesce(answer, F.lit(""))))
    swap = lambda a, pairs: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, a)
    en = F.regexp_replace(swap(t, fixed.PLAIN_WORDS), r"\s+,", ",")
    en = F.when(en.contains(fixed.PLAIN_END), F.trim(F.substring_index(en, fixed.PLAIN_END, 1))).otherwise(en)
    t = F.when(zh, swap(t, fixed.PLAIN_WORDS_ZH)).otherwise(en)
    for p, by in ((r'"\s*\d+\.\s*', " "), (r"\(\.\s*$", ""), (r"\s*\(\s*$", ""), (r"\s*-\s*$", ""), (r"\s+", " "), (r"^[ ;:,-]+|[ ;:,-]+$", "")):
        t = F.regexp_replace(t, p, by)
    return _cut_at_sentence(t, most, 80, r"\. |。", "...")


def known_fact(answer: Column, zh: Column) -> Column:
    """The short form of an English answer with a known phrase; every other answer trimmed."""
    low = F.lower(answer)
    cases = [(reduce(lambda a, b: a & b, [low.contains(w) for w in words]), said) for words, said in fixed.KNOWN_FACTS]
    return reduce(lambda a, c: a.when(~zh & c[0], c[1]), cases[1:], F.when(~zh & cases[0][0], cases[0][1])).otherwise(F.trim(answer))


def fees(records: DataFrame) -> DataFrame:
    """(ticker, percent) of every ticker: the first value in (0, 5] % of the answers about charges, by tag or hint; of all
    answers where none is about charges. ``records`` (ticker, pos, tag, answer). One partial aggregate, no group in a task."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    hint = F.lower(text("tag")).contains("fees_charges") | C.contains_any(text("answer"), fixed.FEE_HINTS)
    d = records.select("ticker", "pos", hint.alias("hint"), F.get(C.realistic_percents(text("answer")), F.lit(0)).alias("p"))
    first = lambda c: F.min(F.when(c & F.col("p").isNotNull(), F.struct("pos", "p")))["p"]
    g = d.groupBy("ticker").agg(F.max("hint").alias("hinted"), first(F.col("hint")).alias("a"), first(F.lit(True)).alias("b"))
    return g.select("ticker", F.when(F.col("hinted"), F.col("a")).otherwise(F.col("b")).alias("percent"))


def _languages(records: DataFrame) -> DataFrame:
    """Every record once for either side that asks, with ``ok`` where its language is one of that side."""
    side = F.explode(F.array(F.lit(True), F.lit(False))).alias("zh")
    ok = F.when(F.col("zh"), F.col("language").isin("zh-HK", "zh", "en")).otherwise(F.col("language").isin("en", "zh-HK"))
    return records.select("*", side).withColumn("ok", F.coalesce(ok, F.lit(False)))


def feature_cards(records: DataFrame, most: int = 210) -> DataFrame:
    """(ticker, zh, reply) in both languages: of each wanted tag the ticker's first answer, in plain words; null where no tag
    has one. ``records`` (ticker, pos, tag, language, answer). A ticker without a record of a side's languages uses all."""
    d = _languages(records.select("ticker", "pos", "tag", "language", "answer"))
    asked = d.groupBy("ticker", "zh").agg(F.max("ok").alias("any"))
    tags = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("name")) for i, t in enumerate(fixed.FEATURE_TAGS)])
    of = F.filter(tags, lambda t: F.contains(F.lower(F.coalesce("tag", F.lit(""))), t["name"]))
    some = d.select("ticker", "zh", "ok", "pos", "answer", F.explode(F.transform(of, lambda t: t["n"])).alias("n"))
    # The first row of either kind, ok or not; which kind counts is the ticker's, so that no rows travel twice.
    first = some.groupBy("ticker", "zh", "n", "ok").agg(F.min(F.struct("pos", "answer"))["answer"].alias("answer"))
    told = first.join(asked, ["ticker", "zh"]).filter("ok or not any").groupBy("ticker", "zh", "n").agg(F.max("answer").alias("answer"))
    told = told.withColumn("text", plain(concise(F.col("answer")), F.col("zh"), most)).filter("text <> ''")
    label = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in fixed.FEATURE_TAGS.values()]), F.col("n") + 1)
    line = F.concat(F.lit("- "), F.when(F.col("zh"), label(1)).otherwise(label(0)), F.col("text"))
    lines = told.groupBy("ticker", "zh").agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    head = F.replace(_frame(fixed.FEATURE_REPLY, 0), F.lit("{}"), F.col("ticker").cast("string"))
    return asked.join(lines, ["ticker", "zh"], "left").select("ticker", "zh", F.concat(head, body, _frame(fixed.FEATURE_REPLY, -1)).alias("reply"))


def _frame(reply: dict, i: int) -> Column:
    return F.when(F.col("zh"), reply["zh"][i]).otherwise(reply["en"][i])


def risk_replies(scored: DataFrame, k: int = 3, top: int = 8, least: float = 0.30) -> DataFrame:
    """(query_id, reply) of every question with at least one bullet: up to ``k`` different answers about risks among the
    ``top`` best of it, in plain words. ``scored`` (query_id, zh, item, score, question, answer, tag)."""
    first = top_n(scored, ["query_id"], top, F.col("score").desc(), F.col("item")).filter(F.col("score") >= least)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    about = F.lower(text("tag")).contains("risk") | C.contains_any(text("question"), fixed.LOOKUP_WORDS["risk"])
    short = first.filter(about).select("query_id", "zh", "rank", concise(F.col("answer")).alias("answer"))
    said = short.filter(~C.contains_any(F.col("answer"), fixed.LEGAL_FRAGMENTS)).select("query_id", "zh", "rank", plain(F.col("answer"), F.col("zh"), 220).alias("text"))
    one = top_n(said.filter("text <> ''").withColumn("norm", C.normalise_text(F.col("text"))), ["query_id", "norm"], 1, F.col("rank"), rank="_one")
    best = top_n(one, ["query_id"], k, F.col("rank"), rank="bullet")
    lines = best.groupBy("query_id", "zh").agg(F.array_sort(F.collect_list(F.struct("bullet", "text"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    return lines.select("query_id", F.concat(_frame(fixed.RISK_REPLY, 0), body, _frame(fixed.RISK_REPLY, 1)).alias("reply"))


def discovered(queries: DataFrame, news: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, rank, ticker, item, score): the ``k`` best tickers of each question by their best news row, .65 of the
    share of the question's words in it and .35 of its own score; ties by own score, then ticker and item.

    ``queries`` (query_id, text), ``news`` (item, ticker, text, score). Null scores are 0, news without words score 0,
    questions without words and news without a ticker find nothing.
    Blocks of questions meet blocks of news; each pair of blocks hands on the ``k`` best tickers a question.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    words = F.array_join("ts", " ").alias("ws")
    q = queries.select("query_id", C.tokens(text("text")).alias("ts")).filter(F.size("ts") > 0).select("query_id", words, F.size("ts").alias("n"))
    n = news.filter(text("ticker") != "").select("item", "ticker", C.tokens(text("text")).alias("ts"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("own")).select("item", "ticker", "own", words)
    types = dict(q.dtypes) | dict(n.dtypes)
    every = overlap.in_blocks(q, n, lambda a, b: overlap.best_scored(a, b, k), ", ".join(f"{c} {types[c]}" for c in ("query_id", "ticker", "item", "own")) + ", score double")
    order = lambda: (F.round("score", 9).desc(), F.col("own").desc())
    best = top_n(every, ["query_id", "ticker"], 1, *order(), F.col("item")).drop("rank")
    return top_n(best, ["query_id"], k, *order(), F.col("ticker")).select("query_id", "rank", "ticker", "item", F.round("score", 9).alias("score"))


def discovery_replies(queries: DataFrame, found: DataFrame, news: DataFrame) -> DataFrame:
    """(query_id, reply) of every question of ``queries`` (query_id, zh): its tickers with event (120 characters) and headline
    (160), or the advice to say more. ``news`` (item, headline, event)."""
    cut = lambda c, m: F.coalesce(F.nullif(F.substring(F.col(c), 1, m), F.lit("")), F.lit("N/A"))
    j = found.join(news.select("item", cut("headline", 160).alias("h"), cut("event", 120).alias("e")), "item")
    rows = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ticker", "e", "h"))).alias("rows"))

    def body(language: str) -> Column:
        head, line, tail = fixed.DISCOVERY_REPLY[language]
        a, b, c, d, z = line.replace("{i}", "\0").replace("{t}", "\0").replace("{e}", "\0").replace("{h}", "\0").split("\0")
        said = F.transform("rows", lambda x: F.concat(F.lit(a), x["rank"].cast("string"), F.lit(b), x["ticker"].cast("string"), F.lit(c), x["e"], F.lit(d), x["h"], F.lit(z)))
        return F.when(F.col("rows").isNull(), fixed.NO_DISCOVERY[language]).otherwise(F.concat(F.lit(head), F.array_join(said, "\n"), F.lit(tail)))

    return queries.select("query_id", "zh").join(rows, "query_id", "left").select("query_id", F.when(F.col("zh"), body("zh")).otherwise(body("en")).alias("reply"))
