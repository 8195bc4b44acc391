"""Shortened and plain answers, fees, cards, risks and related news on small tables."""

from lodestream.functions import fixed
from lodestream.operators import answers as A
from pyspark.sql import functions as F


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_concise_keeps_two_sentences_and_cuts_at_the_last_end(spark):
    assert one(spark, "One is here.  Two\nis there! Three goes.", A.concise) == "One is here. Two is there!"
    assert one(spark, "根據基金文件：一。 二。 三。", A.concise) == "一。 二。"
    assert one(spark, None, A.concise) == one(spark, " \n ", A.concise) == ""
    long = "a" * 200 + ". " + "b " * 300
    assert one(spark, long, A.concise) == "a" * 200 + "."
    assert one(spark, "a" * 100 + ". " + "b " * 300, A.concise) == ("a" * 100 + ". " + "b " * 300)[:420].rsplit(" ", 1)[0].strip()


def test_plain_words(spark):
    en, zh = (lambda c: A.plain(c, F.lit(False), 80)), (lambda c: A.plain(c, F.lit(True), 80))
    assert one(spark, "The Sub-Fund , TraHK, tracks. Quick facts: none", en) == "The ETF, the ETF, tracks."
    assert one(spark, "TraHK 是", zh) == "本ETF 是"
    assert one(spark, 'UNDER THE SECTION ENTITLED "x y" it pays (', en) == "it pays"
    assert one(spark, "word " * 40, en) == ("word " * 40)[:80].rsplit(" ", 1)[0].strip() + "..."
    assert one(spark, None, en) == ""


def test_known_facts(spark):
    assert one(spark, "It Tracks Hang Seng Index daily", lambda c: A.known_fact(c, F.lit(False))) == "It tracks the Hang Seng Index."
    assert one(spark, " It tracks hang seng index ", lambda c: A.known_fact(c, F.lit(True))) == "It tracks hang seng index"


def test_fees_take_answers_about_charges_first(spark):
    rows = [("a", 1, None, "yield 3% now"), ("a", 2, "x_FEES_CHARGES", "total 12% and 0.9%"), ("a", 3, None, "expense ratio 0.5%"), ("b", 1, None, "grew 2%"), ("c", 1, None, "management fee is low"), ("c", 2, None, "grew 2%"), ("d", None, None, None)]
    got = dict(A.fees(spark.createDataFrame(rows, "ticker string, pos int, tag string, answer string")).collect())
    assert got == {"a": 0.9, "b": 2.0, "c": None, "d": None}


def test_feature_cards_by_language(spark):
    rows = [("a", 2, "key_risks", "en", "Prices fall."), ("a", 1, "Key_Risks|v2", "fr", "Prix."), ("a", 3, "dividend", "en", ""), ("b", 1, "dividend", "fr", "Oui."), ("b", 2, None, "fr", "x"), ("c", 1, "other", "en", "y")]
    got = {(r.ticker, r.zh): r.reply for r in A.feature_cards(spark.createDataFrame(rows, "ticker string, pos int, tag string, language string, answer string")).collect()}
    head, tail = fixed.FEATURE_REPLY["en"]
    assert got["a", False] == head.replace("{}", "a") + "- Risk highlights: Prices fall." + tail
    assert got["b", False] == head.replace("{}", "b") + "- Dividend: Oui." + tail  # no record of either language: all count
    assert got["b", True].startswith(fixed.FEATURE_REPLY["zh"][0].replace("{}", "b") + "- 派息資訊：Oui.")
    assert got["c", False] is None and len(got) == 6


def test_risk_replies(spark):
    rows = [(1, False, 1, 0.9, "what risks", "Market falls.", None), (1, False, 2, 0.8, "what risks", "market falls", None), (1, False, 3, 0.7, "who", "Other.", "key_risks"),
            (1, False, 4, 0.6, "risk", "It forms an integral part of it", None), (1, False, 5, 0.2, "risk", "Too far.", None), (2, False, 1, 0.9, "who", "No.", "x"), (3, True, 9, 0.5, "風險", "跌。", None)]
    got = dict(A.risk_replies(spark.createDataFrame(rows, "query_id int, zh boolean, item int, score double, question string, answer string, tag string")).collect())
    head, tail = fixed.RISK_REPLY["en"]
    assert got == {1: f"{head}- Market falls.\n- Other.{tail}", 3: fixed.RISK_REPLY["zh"][0] + "- 跌。" + fixed.RISK_REPLY["zh"][1]}


def test_discovery_against_brute_force(spark):
    import random
    import re

    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    news = [(i, rng.choice(["t1", "t2", "t3", "t4", "t5", ""]), " ".join(rng.choices(words, k=rng.randint(0, 4))), rng.choice([None, 0.0, 0.1, 0.5, 0.9, -0.4])) for i in range(60)]
    asked = [(i, " ".join(rng.choices([*words, "zz"], k=rng.randint(0, 4)))) for i in range(25)] + [(99, None)]
    q, n = spark.createDataFrame(asked, "query_id int, text string"), spark.createDataFrame(news, "item int, ticker string, text string, score double")
    split = lambda t: set(re.findall("[a-z0-9]+", t or ""))
    for k in (1, 3):
        want = set()
        for i, text in asked:
            best = {}
            for item, ticker, body, own in news:
                if split(text) and ticker:
                    s = round(0.65 * len(split(text) & split(body)) / len(split(text)) + 0.35 * (own or 0.0), 9) if split(body) else 0.0
                    best[ticker] = min(best.get(ticker, (9,)), (-s, -(own or 0.0), item, ticker))
            want |= {(i, r, t, item, -s) for r, (s, _, item, t) in enumerate(sorted(best.values(), key=lambda x: (x[0], x[1], x[3]))[:k], 1)}
        got = {(r.query_id, r["rank"], r.ticker, r.item, r.score) for r in A.discovered(q, n, k).collect()}
        assert got == {(*w[:4], w[4] + 0.0) for w in want}
    assert A.discovered(q, n.filter("false")).count() == 0
    told = A.discovery_replies(q.select("query_id", F.lit(False).alias("zh")), A.discovered(q, n), n.select("item", F.col("text").alias("headline"), F.lit("").alias("event"))).collect()
    assert len(told) == 26 and {r.reply for r in told if r.query_id == 99} == {fixed.NO_DISCOVERY["en"]}
    assert any("- 1. `t" in r.reply and "event `N/A`" in r.reply for r in told)


def test_reply_guard(spark):
    from lodestream.functions import replies as R

    head = "Using ticker `2800` as the active ETF context.\n\n"
    known = lambda c: R.clean_reply(c, F.lit("2800"), F.lit(True))
    assert one(spark, "It tracks. The code might be incorrect. Fine.\nThe ticker is not listed here\nGood", known) == head + "It tracks. Fine.\nGood"
    assert one(spark, "這並不是一個現有的ETF。", known) == head + "I can continue with risk, benchmark, fee, and alternatives for this ETF."
    # No listed phrase, so a line of the last resort stays.
    assert one(spark, "The ticker looks incorrect", known) == "The ticker looks incorrect"
    assert one(spark, "So. Insufficient local data now. Ok (key ", known) == "So. Ok"
    assert one(spark, "So. Insufficient local data now. Ok (key ", lambda c: R.clean_reply(c, F.lit("2800"), F.lit(True), F.lit(False))) == "So. Insufficient local data now. Ok"
    assert one(spark, " Might be incorrect. ", lambda c: R.clean_reply(c, F.lit("2800"), F.lit(False))) == "Might be incorrect."
    assert one(spark, None, known) == ""


def test_counts_of_shared_words_in_slices():
    import random

    import numpy as np
    from lodestream.operators import overlap

    rng = random.Random(3)
    draw = lambda: " ".join(sorted({f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randint(0, 30))}))
    asked, rows = [draw() for _ in range(70)], [draw() for _ in range(90)]
    want = [[len(set(a.split()) & set(b.split())) for b in rows] for a in asked]
    for cells in (1, 400, 10**6):
        got = np.concatenate([m for _, m in overlap.shared(asked, rows, cells)])
        assert got.tolist() == want
    assert overlap.units(np.array([0.0025390625, 0.0025390635, 1e-9, -0.5])).tolist() == [2539063, 2539064, 1, -500000000]


def test_discovery_pairs_do_not_travel(spark):
    """Words that every question and every news row has: pairs of blocks hand on k rows a question, not one row a pair."""
    q = spark.range(700).select(F.col("id").alias("query_id"), F.concat(F.lit("the of and "), F.col("id").cast("string")).alias("text"))
    n = spark.range(900).select(F.col("id").alias("item"), (F.col("id") % 40).cast("string").alias("ticker"), F.concat(F.lit("the of and x"), F.col("id").cast("string")).alias("text"), F.lit(0.5).alias("score"))
    found = A.discovered(q, n)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert found.filter("rank = 1 and ticker = '0' and item = 0 and abs(score - (0.65 * 3 / 4 + 0.175)) < 1e-9").count() == 700 and found.count() == 2100


def test_lexical_answers_are_alike_by_either_path(spark):
    from lodestream.operators import retrieval

    q = spark.range(600).select(F.col("id").alias("query_id"), F.concat_ws(" ", F.lit("the of"), (F.col("id") % 7).cast("string"), (F.col("id") % 11 + 100).cast("string")).alias("text"))
    r = spark.range(700).select((700 - F.col("id")).alias("item"), F.concat_ws(" ", F.lit("the"), (F.col("id") % 5).cast("string"), (F.col("id") % 13 + 100).cast("string")).alias("text"))
    by = [sorted(map(tuple, retrieval.lexical(q, r, 4, most_tokens=n).select("query_id", "item", "overlap", "rank").collect())) for n in (0, 10**6)]
    texts = {x: set(t.split()) for x, t in r.collect()}
    asked = {x: set(t.split()) for x, t in q.collect()}
    want = [(i, item, -s, n) for i, a in asked.items() for n, (s, item) in enumerate(sorted((-len(a & b) / len(a), item) for item, b in texts.items())[:4], 1)]
    assert by[0] == by[1] == sorted(want)
    assert "Join" not in retrieval.lexical(q, r, 4, most_tokens=0)._jdf.queryExecution().toString()


def test_reply_guard_reads_a_reply_once_and_in_line_with_its_length(spark):
    from lodestream.functions import replies as R

    known = lambda c: R.clean_reply(c, F.lit("2800"), F.lit(True))
    df = spark.createDataFrame([("word " * 20_000 + "might be incorrect here. Fine",)], "t string").select(known(F.col("t")).alias("r"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("local data is currently insufficient") == 1
    assert df.first()[0] == "Using ticker `2800` as the active ETF context.\n\nFine"
