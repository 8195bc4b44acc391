import datetime as dt
import difflib
import math
import os
import random
import re
import statistics
import subprocess
import sys

import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestream import frames
from lodestream.functions import columns as C
from lodestream.operators import clustering, pairs, qa, retrieval, series, stability, text
from lodestream.plans import api, serving
from lodestream.sources import ingest


def col(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_numbers_and_codes(spark):
    for raw, want in (("1,234.5", 1234.5), ("12%", 12.0), ("(1.2)", 1.2), ("1e5", 15.0), ("-", None), ("", None), ("N/A", None), (None, None)):
        assert col(spark, raw, C.clean_numeric) == want
    for raw, want in (("2800", "2800"), ("02800", "2800"), ("2800.HK", "2800"), ("", ""), ("abc", "ABC"), ("123456", "123456"), (None, "")):
        assert col(spark, raw, C.digits_code) == want
    assert col(spark, "02800", C.raw_code) == "02800" and col(spark, "5", C.exchange_symbol) == "0005.HK" and col(spark, "^STOXX50E", C.file_token) == "STOXX50E"


def test_text_functions(spark):
    assert col(spark, "the page 3 of something that is long enough", C.is_noise) and col(spark, "short", C.is_noise)
    assert not col(spark, "A perfectly normal sentence about the index it follows.", C.is_noise)
    assert col(spark, "x" * 200 + " " + "y" * 50, C.summary_sentence) == "x" * 200 + "."
    assert col(spark, " .;", C.summary_sentence) == ""
    assert col(spark, "The Fed raised; rate hikes hit BTC", C.canonical_query) == "the fomc raised; interest rate hike hit bitcoin"
    assert col(spark, "fee 12% then 0.35 % and 4%", C.realistic_percents) == [0.35, 4.0]
    assert col(spark, "哪些 similar ETF?", C.intent) == "model1_related" and col(spark, "hello", C.intent) == "general"
    assert sorted(col(spark, "Ab1 中文字 ab1", C.tokens)) == ["ab1", "中文字"]
    assert col(spark, None, lambda c: C.percent(c.cast("double"))) == "-"


def test_jaccards(spark):
    def both(a, b, f):
        return spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(f(F.col("a"), F.col("b"))).first()[0]

    assert both([], [], C.jaccard) == 1 and both([], [], C.ranked_jaccard) == 1 and both(["x"], [], C.jaccard) == 0
    a, b = ["x", "y", "z"], ["y", "x", "w"]
    wa, wb = ({t: 1 / math.log2(i + 2) for i, t in enumerate(v)} for v in (a, b))
    keys = {*a, *b}
    want = sum(min(wa.get(k, 0), wb.get(k, 0)) for k in keys) / sum(max(wa.get(k, 0), wb.get(k, 0)) for k in keys)
    assert abs(both(a, b, C.ranked_jaccard) - want) < 1e-12 and both(a, b, C.jaccard) == 0.5


def bars_of(spark, named):
    day = dt.date(2020, 1, 1)
    rows = [(t, day + dt.timedelta(days=i), c) for t, cs in named.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def test_risk_features_by_hand(spark):
    rng = random.Random(0)
    walk = lambda n: [100 * math.exp(sum(rng.gauss(0, 0.01) for _ in range(1)) + i * 1e-3) for i in range(n)]
    named = {"a": walk(757), "b": walk(253), "c": walk(252), "d": walk(199), "e": [5.0] * 300, "f": [None, *walk(260)]}
    got = {r.ticker: r for r in series.risk_features(bars_of(spark, named)).collect()}
    assert set(got) == {"a", "b", "c", "e", "f"}
    a = named["a"]
    rets = [math.log(y / x) for x, y in zip(a, a[1:])]
    assert abs(got["a"].return_1y - (a[-1] / a[-253] - 1)) < 1e-9 and abs(got["a"].return_3y - (a[-1] / a[-757] - 1)) < 1e-9 and got["a"].return_5y is None
    assert abs(got["a"].volatility_30d - statistics.stdev(rets[-30:]) * 252**0.5) < 1e-9
    assert got["c"].return_1y is None and got["b"].return_1y is not None
    assert got["e"].sharpe_ratio is None and got["e"].return_to_risk_1y is None and got["f"].obs_count == 259


def test_monthly_volatility_pads_gaps(spark):
    rows = [("x", dt.date(2020, m, 15), c) for m, c in ((1, 1.0), (2, 2.0), (4, 4.0))]
    got = series.monthly_volatility(spark.createDataFrame(rows, "ticker string, date date, close double")).first()
    assert got.months == 4 and abs(got.monthly_volatility - statistics.stdev([1.0, 0.0, 1.0])) < 1e-12


def test_correlation_guard_and_overlap(spark):
    rng = random.Random(1)
    x = [100 + rng.random() for _ in range(300)]
    b = bars_of(spark, {"flat": [7.0] * 300, "moving": x, "short": x[:200]})
    got = {r.ticker: r for r in series.correlation_and_beta(b, bars_of(spark, {"ref": x})).collect()}
    assert set(got) == {"flat", "moving"} and got["flat"].corr is None and abs(got["moving"].corr - 1) < 1e-9 and abs(got["moving"].beta - 1) < 1e-9


def greedy(edges, cap):
    seen, kept = {}, []
    for d, a, b in sorted(edges):
        if seen.get(a, 0) < cap and seen.get(b, 0) < cap:
            kept.append((d, a, b))
            seen[a], seen[b] = seen.get(a, 0) + 1, seen.get(b, 0) + 1
    return kept


def test_degree_cap_is_the_sequential_scan(spark):
    rng = random.Random(2)
    for cap in (1, 2, 3):
        edges = list({(rng.randint(1, 4) / 4, a, b) for a, b in ((rng.randrange(9), rng.randrange(9)) for _ in range(60)) if a < b})
        df = spark.createDataFrame(edges, "d double, a long, b long")
        assert sorted(map(tuple, pairs.degree_capped(df, "a", "b", ["d"], cap).select("d", "a", "b").collect())) == sorted(greedy(edges, cap))


def clustered(spark, n=160, d=6):
    """Rows of two clusters on a coarse grid, so that distances tie, one ticker named again."""
    rng = random.Random(4)
    rows = [("m", i % 2, i if i < n - 3 else 7, rng.choice(["", "us", "hk", "uk"]), [rng.randint(0, 4) / 2 for _ in range(d)]) for i in range(n)]
    return spark.createDataFrame([*rows, rows[9]], "perspective string, cluster_id int, ticker long, geo string, pcs array<double>"), rows


def test_capped_rings_are_the_scan_over_all_pairs(spark, monkeypatch):
    """The rings keep what a scan over all pairs keeps, and full tickers take no part in the wider ones."""
    df, _ = clustered(spark)
    monkeypatch.setattr(pairs, "FIRST", 0.5)
    monkeypatch.setattr(pairs, "GROWTH", 2.0)
    met = []
    whole = pairs.home_bias
    monkeypatch.setattr(pairs, "home_bias", lambda rows, most: met.append(rows.select("ticker").distinct().count()) or whole(rows, most))
    all_pairs = [(r.pc_distance, r.source_ticker, r.alternative_ticker) for r in whole(df, 2.5).collect()]
    for cap in (1, 3):
        met.clear()
        got = pairs.home_bias_capped(df, 2.5, cap).collect()
        assert sorted((r.pc_distance, r.source_ticker, r.alternative_ticker) for r in got) == sorted(set(greedy(all_pairs, cap)))
        assert len(met) > 2 and met[-1] < met[0]


def test_pairs_of_names_that_come_again_are_told_once(spark):
    df, rows = clustered(spark)
    want = {(a[2], a[3], b[2], b[3], round(math.dist(a[4], b[4]), 9)) for a in rows for b in rows if a[1] == b[1] and a[2] != b[2] and b[3] and a[3] != b[3] and math.dist(a[4], b[4]) <= 2.0}
    out = pairs.home_bias(df, 2.0)
    got = [(r.source_ticker, r.source_geo, r.alternative_ticker, r.alternative_geo, round(r.pc_distance, 9)) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    single = pairs.home_bias(df.filter("ticker <> 7").dropDuplicates(["ticker"]), 2.0)._jdf.queryExecution().analyzed().toString()
    # The pairs come last: no join and no exchange lies above where blocks meet.
    assert "Join" not in single.split("MapInArrow")[0] and "Deduplicate" not in single and "Distinct" not in single


def test_context_exchanges_the_nearest_of_a_task_only(monkeypatch):
    import pandas as pd

    rng = random.Random(5)
    f = pd.DataFrame([(rng.randrange(20), rng.randrange(40), rng.choice(["home", "twin"]), rng.randint(0, 9) / 2, rng.choice("pq")) for _ in range(3000)], columns=["ticker", "other", "signal", "pc_distance", "perspective"])
    best = lambda x: x.sort_values(["pc_distance", "signal"], ascending=[True, False], kind="stable").sort_values(["pc_distance", "signal", "perspective"], ascending=[True, False, True]).drop_duplicates(["ticker", "other"]).sort_values(["ticker", "pc_distance", "other"]).groupby("ticker").head(3).values.tolist()
    for held in (10, 100, 10_000):
        monkeypatch.setattr(pairs, "HELD", held)
        got = pd.concat(pairs._nearest(3)(f[i : i + 50] for i in range(0, len(f), 50)))
        assert best(got) == best(f)
    assert len(got) < len(f) / 4


def test_pairs_label_rules(spark):
    rows = [("m", 1, "a", "", "k1", [0.0]), ("m", 1, "b", "us", "k2", [1.0]), ("m", 1, "c", "hk", "k1", [1.5]), ("m", 2, "d", "us", "k9", [0.0]), ("m", 1, "e", "hk", "k3", [None])]
    df = spark.createDataFrame(rows, "perspective string, cluster_id int, ticker string, geo string, kind string, pcs array<double>")
    home = {(r.source_ticker, r.alternative_ticker) for r in pairs.home_bias(df, 2.0).collect()}
    assert home == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "b")}
    twin = pairs.hidden_twins(df, ["geo", "kind"], 2.0).collect()
    assert [(r.ticker_a, r.ticker_b, r.label_mismatch) for r in twin] == [("b", "c", "geo:us!=hk|kind:k2!=k1")]


def test_merge_and_budget_folds(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "b.", "c;", "d", ""])], "k int, pos int, text string")
    assert [r.text for r in text.merge_fragments(df, "k").orderBy("merged_id").collect()] == ["a b.", "c; d"]


def test_impute_cap_and_first(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None), (None, None), (None, 8.0)], "g string, v double")
    assert sorted(r.v for r in frames.impute(df, "v", "g").collect()) == [1.0, 2.0, 3.0, 4.0, 8.0, 8.0]
    t = spark.createDataFrame([(k, i) for i in range(9) for k in "xyz"], "k string, i int")
    assert frames.fair_cap(t, ["k"], 2, 5, F.col("i"), F.col("k")).count() == 5


def test_stability_of_equal_and_disjoint_lists(spark):
    rows = [(1, "d", v, r, f"t{r}", 1.0 - r / 10) for v in (1, 2) for r in (1, 2, 3)] + [(2, "d", v, r, f"t{v}{r}", 1.0 - r / 10) for v in (1, 2) for r in (1, 2, 3)] + [(3, "d", 1, 1, "x", 1.0)]
    df = spark.createDataFrame(rows, "concept_id int, domain string, variant_id int, rank int, item string, score double")
    got = {r.concept_id: r for r in stability.concept_stability(df, 3).collect()}
    assert set(got) == {1, 2} and got[1].composite_stability_score == 1.0 and got[1].avg_score_corr_ticker_spearman == 1.0
    assert got[2].avg_topk_jaccard == 0 and got[2].top1_consistency == 0.5


def records(spark, rows):
    """(item, ticker, question, answer), all English and without a tag unless given."""
    return spark.createDataFrame([(*r, "en", "")[:6] if len(r) == 4 else r for r in rows], "item long, ticker string, question string, answer string, language string, tag string")


def test_fuzzy_lookup_ratio(spark):
    q = spark.createDataFrame([(1, "7", "what is the fee of fund a?")], "query_id long, ticker string, text string")
    rows = [(1, "7", "what is the fee of fund b?", "x" * 60), (2, "7", "what colour has the sky?", "y" * 60), (3, "8", "what is the fee of fund a?", "z" * 60), (4, "7", "what is the fee of fund c?", "the lot size is 100 units of it")]
    got = qa.fuzzy_lookup(q, records(spark, rows), k=2).collect()
    assert [r["item"] for r in got] == [1, 4] and abs(got[0].score - got[1].score - 0.45) < 1e-9
    ratio = difflib.SequenceMatcher(None, "what is the fee of fund a?", "what is the fee of fund b?").ratio()
    assert got[0]["item"] == 1 and abs(got[0].score - (0.7 * ratio + 0.3 * 6 / 8 + 0.16)) < 1e-9


def test_fuzzy_lookup_without_a_common_token(spark):
    q = spark.createDataFrame([(1, "a", "feess of funnds"), (2, "a", "基金費用是多少"), (3, "a", "zzzz")], "query_id long, ticker string, text string")
    c = records(spark, [(1, "a", "fees off fundds", "x" * 60), (2, "a", "基金費用多少", "y" * 60), (3, "a", "q", "z" * 60), (4, "a", "", "z" * 60)])
    assert {(r["query_id"], r["item"]) for r in qa.fuzzy_lookup(q, c).collect()} == {(1, 1), (2, 2)}


def test_fuzzy_lookup_equals_brute_force(spark):
    rng = random.Random(5)
    words = "fund risk fees charge the a of index dividend tracking error growth 費用 風險 gold".split()
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "x"]) for _ in range(n))
    asked = [(i, f"t{i % 2}", text(rng.randint(3, 45))) for i in range(12)]
    answers = ["short", "x" * 60, "each lot size is of 100 units of the fund", "authorized under section 104 of the ordinance"]
    known = [(i, f"t{i % 3}", text(rng.randint(3, 45)), rng.choice(answers), rng.choice(["en", "zh-HK", "zh"]), rng.choice(["key_risks", "fees_charges", "dividend", ""])) for i in range(90)]
    want = []
    asks = lambda t, kind: any(w in t for w in qa.C.fixed.INTENTS[kind])
    for i, ticker, t in asked:
        zh = bool(re.search("[\u4e00-\u9fff]", t))
        scored = []
        for j, other, u, a, language, tag in known:
            if other != ticker or language not in (["zh", "zh-HK", "en"] if zh else ["en", "zh-HK"]):
                continue
            x, y = (set(re.findall("[a-z0-9\u4e00-\u9fff]+", v)) for v in (t, u))
            s = 0.7 * difflib.SequenceMatcher(None, t, u).ratio() + 0.3 * len(x & y) / len(x | y)
            is_ = {kind: any(w in u for w in ws) for kind, ws in qa.C.fixed.LOOKUP_WORDS.items()}
            if asks(t, "risk"):
                if not is_["risk"] and "risk" not in tag:
                    continue
                s += 0.14 * is_["risk"] + 0.14 * ("risk" in tag) - 0.2 * ("section 104" in a)
            if asks(t, "fee"):
                if not is_["fee"] and "fees_charges" not in tag:
                    continue
                s += 0.16 - 0.45 * ("lot size" in a)
            if asks(t, "dividend"):
                if not is_["dividend"] and "dividend" not in tag:
                    continue
                s += 0.14
            if asks(t, "tracking"):
                s += 0.12 * is_["tracking"]
            s -= 0.08 if len(a) < 25 else 0
            if s >= 0.38:
                scored.append((-round(s, 9), j))
        want += [(i, j, -s) for s, j in sorted(scored)[:2]]
    got = qa.fuzzy_lookup(spark.createDataFrame(asked, "query_id long, ticker string, text string"), records(spark, known), k=2)
    assert sorted((r["query_id"], r["item"], round(r.score, 9)) for r in got.collect()) == sorted(want) and len(want) > 8


@pytest.mark.parametrize("block", [1, 7, 500])
def test_fuzzy_lookup_pools_are_of_a_ticker(spark, block):
    """A record outside the pool counts where no record of the ticker is inside, wherever blocks are cut."""
    rows = [(1, "a", "what does it hold?", "x" * 60, "en", ""), (2, "a", "what does it hold", "y" * 60, "fr", ""), (3, "b", "what does it hold", "y" * 60, "fr", ""), (4, "c", "", "y" * 60, "en", ""), (5, "c", "what does it hold", "y" * 60, "fr", "")]
    rows += [(n, "a", f"filler {n} of many", "z" * 60, "fr", "") for n in range(10, 30)]
    asked = [(1, "a", "what does it hold"), (2, "b", "what does it hold"), (3, "c", "what does it hold"), (4, None, "what does it hold"), (5, "b", "which etf is it, what does it hold"), (6, "b", None)]
    got = qa.fuzzy_lookup(spark.createDataFrame(asked, "query_id long, ticker string, text string"), records(spark, rows), block=block).collect()
    assert sorted((r["query_id"], r["item"], round(r.score, 6)) for r in got) == [(1, 1, round(0.7 * 34 / 35 + 0.3, 6)), (2, 3, 1.0)]


def test_fuzzy_bounds_lose_nothing_and_spare_pairs(monkeypatch):
    """Texts on both sides of 200 characters against the plain ratio, with and without a floor; few pairs are compared."""
    rng = random.Random(8)
    speak = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3], k=rng.randint(1, 9))) for _ in range(n))
    known = [speak(rng.choice([3, 20, 38, 60])) + rng.choice(["", " jazz", "?"]) for _ in range(120)]
    asked = [speak(rng.choice([2, 25, 55])) for _ in range(12)] + [x.rsplit(" ", 1)[0] for x in known[:12]]
    c = pd.DataFrame({"item": range(120), "ck": known, "ct": [sorted(set(x.split())) for x in known], "tag": "", "answer": "x" * 60, "language": "en"})
    q = pd.DataFrame({"query_id": range(24), "qk": asked, "qt": [sorted(set(x.split())) for x in asked], "pool": [None] * 24, "kinds": [[False] * 4] * 24})
    full = {}
    for i, a in enumerate(asked):
        for j, b in enumerate(known):
            x, y = set(a.split()), set(b.split())
            full[i, j] = 0.7 * difflib.SequenceMatcher(None, a, b).ratio() + 0.3 * len(x & y) / len(x | y)
    made = []
    ratio = qa._ratio
    monkeypatch.setattr(qa, "_ratio", lambda m, least: made.append(1) or ratio(m, least))
    for k, accept in ((1, 0.38), (3, 0.2), (2, 0.3)):
        want = [(i, j, s) for i in range(24) for s, j in sorted(((-full[i, j], j) for j in range(120) if full[i, j] >= accept))[:k]]
        floors = [sorted((full[i, j] for j in range(120)), reverse=True)[k - 1] for i in range(24)]
        for asks in (q, q.assign(floor=floors), q.assign(floor=None)):
            got = qa._best(asks, c, k, accept, {"risk": [], "fee": [], "tracking": []}, [])
            assert [(r.query_id, r.item) for r in got.itertuples()] == [(i, j) for i, j, _ in want]
            assert all(abs(s + w) < 1e-9 for s, (*_, w) in zip(got.score, want, strict=True))
        if accept == 0.38:
            assert len(made) < 3 * 24 * 120 / 4


def test_ratio_is_left_off_by_subsequences_and_exact_else(monkeypatch):
    """The ratio is difflib's wherever it is reached, with texts of common characters too; what can't reach it is told after few blocks."""
    rng = random.Random(8)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    for n in range(600):
        letters = "ab" if n % 3 else "abcdefghij klmnop"
        a, b = text(rng.randint(0, 60), letters), text(rng.randint(0, 60), letters)
        if n % 4 == 0:
            a, b = a * 5 + b, b + a * 6
        m, want = difflib.SequenceMatcher(None, a, b), difflib.SequenceMatcher(None, a, b).ratio()
        assert qa._ratio(m, want) == want and qa._ratio(m, max(0.0, want - 0.1)) == want
        if a and b and not m.bpopular:
            assert qa._longest(a, b)[2] == m.find_longest_match().size and (not qa._longest(a, b)[2] or qa._longest(a, b) == tuple(m.find_longest_match()))
    blocks = []
    longest = qa._longest
    monkeypatch.setattr(qa, "_longest", lambda a, b: blocks.append(1) or longest(a, b))
    told = [qa._ratio(difflib.SequenceMatcher(None, text(150, "abcdefghij"), text(150, "abcdefghij")), 0.7) for _ in range(20)]
    assert told == [None] * 20 and len(blocks) <= 40


def test_fuzzy_lookup_needs_no_package_on_workers(tmp_path):
    q = pd.DataFrame({"query_id": [1], "qk": ["fee of it"], "qt": [["fee", "of", "it"]], "pool": [None], "kinds": [[False, True, False, False]]})
    c = pd.DataFrame({"item": [3], "ck": ["fee of it"], "ct": [["fee", "of", "it"]], "tag": [""], "answer": ["x" * 60], "language": ["en"]})
    about, lots = dict(qa.C.fixed.LOOKUP_WORDS), list(qa.C.fixed.LOT_WORDS)
    call = qa._best
    (tmp_path / "work").write_bytes(cloudpickle.dumps(lambda: call(q, c, 1, 0.38, about, lots)))
    code = "import pickle, sys; r = pickle.load(open('work', 'rb'))(); assert not any(m.startswith('lodestream') for m in sys.modules); print(r.values.tolist())"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert done.stdout.strip() == "[[1.0, 3.0, 1.16]]", done.stderr


def test_fuzzy_query_takes_whole_texts_of_every_turn(spark, tmp_path):
    long = "what is known of " + " ".join(f"word{i}" for i in range(12))
    turns = [(c, t, r, x) for c, end in ((1, "first of all"), (11, "last of all")) for t, r, x in ((1, "user", f"{long} {end}"), (2, "assistant", "y" * 60))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["query_id"]: (r["item"], r.score) for r in serving.Q["qa_fuzzy_lookup"](spark, str(tmp_path)).collect()}
    want = {}
    for c, end in ((1, "first of"), (11, "last of")):
        asked, known = f"{long} {end}", f"{long} {end} all"
        want[c * 1000 + 1] = (c * 1000 + 1, 0.7 * difflib.SequenceMatcher(None, asked, known).ratio() + 0.3 * len(set(asked.split())) / len(set(known.split())))
    assert got.keys() == want.keys() and all(got[q][0] == want[q][0] and abs(got[q][1] - want[q][1]) < 1e-6 for q in want)


def test_ticker_resolution_knows_every_nation(spark, tmp_path):
    """The first nation has a code of its own too: it is found by name, by code and among the suggestions."""
    spark.createDataFrame([(0, "ALGERIA", 0), (7, "GERMANY", 1)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "AFRICA"), (1, "EUROPE")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    turns = [(4, 0, "user", "what of algeria"), (25, 0, "user", "x"), (26, 0, "user", "x"), (50, 0, "user", "0001")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.query_id: (r.rule, r.ticker) for r in serving.Q["ticker_resolution"](spark, str(tmp_path)).collect()}
    assert got[4000] == (2, "0001") and got[26000] == (2, "0008") and got[50000] == (1, "0001") and got[25000][0] > 2


def test_degree_cap_writes_a_round_once(spark, monkeypatch):
    """A path of 12 edges that settles over several rounds: one written table a round and one for the edges."""
    edges = spark.createDataFrame([(f"v{i:02d}", f"v{i + 1:02d}", float(i)) for i in range(12)], "a string, b string, d double")
    written = []
    keep = pairs.materialise
    monkeypatch.setattr(pairs, "materialise", lambda df: written.append(set(df.columns)) or keep(df))
    got = sorted(r.d for r in pairs.degree_capped(edges, "a", "b", ["d"], 1).collect())
    assert got == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]
    assert all({"keep", "full"} <= c for c in written[1:]) and len(written) > 3


def test_shortest_answer_rule(spark):
    rows = [("q", 1, "a" * 60), ("q", 2, "b" * 50), ("q", 3, "c" * 50), ("q", 4, "d" * 20), ("p", 1, "e" * 45), ("p", 2, "f" * 45)]
    got = {r.k: r.answer[0] for r in qa.shortest_answers(spark.createDataFrame(rows, "k string, pos int, answer string"), ["k"]).collect()}
    assert got == {"q": "b", "p": "e"}


def test_retrieval_in_blocks_and_eval(spark):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, None)], "item long, v array<double>")
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "query_id long, q array<double>")
    assert {r["item"] for r in retrieval.similar(queries, corpus, 1).collect()} == {4}
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(300)]
    many = spark.createDataFrame(rows, "query_id long, q array<double>")
    got = {}
    for r in retrieval.similar(many, many.toDF("item", "v"), 3, chunk=40, batch_bytes=70 * 48).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["item"])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    assert got == {i: [j for _, j in sorted((-dot(v, w), j) for j, w in rows)[:3]] for i, v in rows}


def test_a_stability_run_of_the_default_size(spark):
    """100 concepts of 20 headlines are 2,000 queries; the encoder is two hashes of the text."""
    encode = lambda t: F.array((F.pmod(F.xxhash64(t), F.lit(97)) / 97).cast("double"), (F.pmod(F.xxhash64(t, F.lit(1)), F.lit(89)) / 89).cast("double"))
    corpus = spark.createDataFrame([(i, [(i % 7) / 7, (i % 11) / 11]) for i in range(40)], "item long, v array<double>")
    assert api.run_stability(spark, encode, corpus, concepts=100, variants=20)["concepts"].count() == 100


def test_lexical_batch_and_join_agree(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 6)))
    q, r = (spark.createDataFrame([(i, text()) for i in range(n)], f"{name} long, text string") for n, name in ((15, "query_id"), (60, "item")))
    key = lambda d: sorted((x["query_id"], x["item"], x["rank"], round(x.overlap, 9)) for x in d.collect())
    assert key(retrieval.lexical(q, r, 3)) == key(retrieval.lexical(q, r, 3, most_tokens=0)) != []


def test_split_counts_are_exact(spark):
    for n, want in ((1, 1), (10, 1), (39, 1), (40, 2), (400, 20)):
        d = spark.range(n).repartition(3)
        got = {r["id"] for r in qa.train_eval_split(d, "id").filter("split = 'eval'").collect()}
        assert len(got) == want == len({r["id"] for r in qa.train_eval_split(d.repartition(5), "id").filter("split = 'eval'").collect()} & got)
    assert qa.train_eval_split(spark.range(0), "id").count() == 0
    assert qa.train_eval_split(spark.createDataFrame([(1,)] * 60, "id long"), "id").filter("split = 'eval'").count() == 3


def test_topics_labels_names_and_caches(spark, tmp_path):
    s = spark.createDataFrame([("a", i, t) for i, t in enumerate(["The Trustee Fee is 1%", "VOLATILE prices", "no topic", "hk$3 billion", *["fees apply"] * 6])], "ticker string, pos int, text string")
    got = {(r.topic, r["rank"]): r["pos"] for r in qa.topic_rows(s, "ticker").collect()}
    assert got == {("key_risks", 1): 1, ("fees_charges", 1): 0, **{("fees_charges", i): i + 2 for i in range(2, 6)}}
    flat = frames.flatten_names(spark.createDataFrame([(1, 2, 3)], "`Close|X` int, `Close|Y` int, Date int"))
    assert flat.columns == ["Close", "Date"] and flat.first()["Close"] == 1
    merged = ingest.merge_replies(spark.createDataFrame([("k", "old"), ("j", "same")], "key string, reply string"), spark.createDataFrame([("k", "new")], "key string, reply string"), "key")
    assert {tuple(r) for r in merged.collect()} == {("k", "new"), ("j", "same")}
    p = spark.createDataFrame([("0", "x", 1), ("5", " ", 2), ("5", "b", 3), ("5", "a", 4)], "ticker string, profile_text string, o int")
    assert [tuple(r) for r in retrieval.risk_corpus(p, "ticker", order="o").collect()] == [("0005", "b")]
    assert [p.name for p in api.default_perspectives(spark.createDataFrame([(1.0, 1.0)], "corr_x double, beta_x double"))] == ["return_risk_profile", "macro_sensitivity"]


def test_evaluation_without_labels(spark):
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "item long, v array<double>")
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "query_id long, q array<double>")
    none = retrieval.evaluate(retrieval.similar(queries, corpus, 1), spark.createDataFrame([], "query_id long, item long"), 1).first()
    assert none.labelled == 0 and none.top1_precision is None


def test_scaling_pca_silhouette(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) + 9 * (i % 2), rng.gauss(0, 1) + 9 * (i % 2), 4.0]) for i in range(60)]
    z = clustering.standardise(spark.createDataFrame(rows, "ticker int, x array<double>"))
    xs = [r.x for r in z.collect()]
    assert abs(statistics.pstdev(x[0] for x in xs) - 1) < 1e-9 and all(x[2] == 0 for x in xs)
    out = clustering.auto_kmeans(clustering.principal_components(z).select("ticker", "pcs"), "ticker", "pcs")
    groups = {r.ticker % 2: r.cluster_id for r in out.collect()}
    assert out.first().selected_k == 2 and len(set(groups.values())) == 2


def test_pipelines_run(spark):
    rng = random.Random(6)
    base = [100 + rng.random() for _ in range(300)]
    named = {f"t{i}": [b * (1 + 0.01 * rng.random()) + i for b in base] for i in range(8)}
    meta = spark.createDataFrame([(f"t{i}", ["hk", "us"][i % 2], f"k{i % 3}", f"f{i}") for i in range(8)], "ticker string, geo string, kind string, focus string")
    out = api.run_dna_pipeline(bars_of(spark, named), bars_of(spark, {"ref1": base, "ref2": base[::-1]}), meta, ["geo", "kind", "focus"], "geo")
    assert out["features"].count() == 8 and out["views"].select("perspective").distinct().count() == 2
    assert out["home_bias"].count() > 0 and out["hidden_twins"].columns
    s = spark.createDataFrame([("t", i, t) for i, t in enumerate(["The management fee of the fund is 0.5% a year.", "Investors face currency risk and credit risk in this fund at all times.", "The base currency: HKD is used for all classes."])], "ticker string, pos int, text string")
    made = api.generate_qa(s)
    assert made.count() >= 2 and made.select("id").distinct().count() == made.count()


def test_replies(spark):
    from lodestream.functions import replies as R

    known = lambda c: R.clean_reply(c, F.lit("2800"), F.lit(True))
    assert col(spark, "It tracks the index. There is no ETF with the ticker 2800. Fine.", known) == "Using ticker `2800` as the active ETF context.\n\nIt tracks the index. Fine."
    assert col(spark, "All good. Would you like more", known) == "All good." and col(spark, "It tracks.", known) == "It tracks."
    facts = col(spark, "Stock code: 2800 Trading lot size: 500 units  Fund manager: A B  Base currency: HKD", R.key_facts)
    assert (facts.stock_code, facts.trading_lot_size, facts.base_currency, facts.dividend_policy) == ("2800", "500 units", "HKD", None)
    assert col(spark, "How does low NAV matter?", lambda c: R.chinese_question(c, F.lit("1"))) == "這隻ETF如何執行其追蹤策略（1）？"
    df = spark.createDataFrame([("a",), ("b",)], "x string")
    assert R.only_if_any(df, F.col("x") == "z").count() == 2 and R.only_if_any(df, F.col("x") == "a").count() == 1


def test_question_gates_and_names(spark):
    asks = lambda q, lang: col(spark, q, lambda c: C.is_question(c, F.lit(lang)))
    assert asks("這隻ETF的費用是多少", "zh-HK") and not asks("請總結風險？", "zh") and not asks("這隻ETF很好", "zh")
    assert asks("What is it?", "en") and not asks("What is it", "en") and not asks("Tell me?", "en")
    assert col(spark, "02800.HK", C.file_stems) == ["02800.HK", "2800", "02800"] and col(spark, " ", C.file_stems) == [] and col(spark, "abc", C.file_stems) == ["abc"]
    assert col(spark, "0000", C.file_stems) == ["0000", "00000"] and col(spark, None, C.file_stems) == []
    assert col(spark, "_A b/c?.pdf_", C.safe_file_name) == "A_b_c_.pdf"
    for path, want in (("x/documentation/2800/csv", "02800"), ("x/02800/csv/csv/", "02800"), ("x/280/csv", "UNKNOWN"), ("csv", "UNKNOWN")):
        assert col(spark, path, C.code_of_path) == want
    assert col(spark, "a  b " * 60, lambda c: C.cut_words(c, 10)) == "a b a b a..." and col(spark, " a  b ", lambda c: C.cut_words(c, 10)) == "a b"
    assert col(spark, "0.955", lambda c: C.percent(c.cast("double"))) == f"{0.955:.2f}%" and col(spark, "12345.675", lambda c: C.percent(c.cast("double"))) == "12345.67%"


def test_context_of_pairs(spark):
    views = spark.createDataFrame([("a", "p", 2), ("a", "q", 1), ("b", "p", 3), ("b", "q", 3), ("b", "r", 1), ("c", "p", None)], "ticker string, perspective string, cluster_id int")
    home = spark.createDataFrame([("a", "b", None, "p"), ("a", "d", 0.5, "p")], "source_ticker string, alternative_ticker string, pc_distance double, perspective string")
    twins = spark.createDataFrame([("a", "b", 0.7, "q"), ("b", "e", None, "p")], "ticker_a string, ticker_b string, pc_distance double, perspective string")
    got = {r["ticker"]: r for r in pairs.context(views, home, twins).collect()}
    assert [got[t]["dominant_cluster"] for t in "abc"] == [1, 3, None]
    assert [(x["ticker"], x["signal"], x["pc_distance"]) for x in got["a"]["alternatives"]] == [("d", "home_bias_candidate", 0.5), ("b", "hidden_twin_candidate", 0.7)]
    assert [(x["ticker"], x["pc_distance"]) for x in got["b"]["alternatives"]] == [("a", 0.7), ("e", 999.0)] and got["c"]["alternatives"] == []


def test_mappable_falls_back(spark):
    t = lambda xs: spark.createDataFrame([(x,) for x in xs], "k string")
    keys = lambda a, b: sorted(r[0] for r in frames.mappable(t(a), t(b), "k").collect())
    assert keys("abb", "bc") == ["b"] and keys("ab", "") == ["a", "b"] and keys("", "bc") == ["b", "c"] and keys("", "") == [] and keys("a", "b") == []
    d = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "k string, v string, o int")
    assert sorted(map(tuple, frames.last_of(d, "k", "v", F.col("o")).collect())) == [("a", "y"), ("b", "z")]


def test_hybrid_ranks_like_brute_force(spark):
    rng = random.Random(5)
    words = ["oil", "gold", "china", "bond", "yield", "alpha", "beta", "gamma"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    qs = [(i, say(4) if i else "") for i in range(8)]
    rows = [(t, f"n{t}", say(5)) for t in range(30)]
    risks = [(q, t, rng.choice([-0.1, 0.2, 0.5])) for q, _ in qs for t in range(20, 40) if rng.random() < 0.4]
    news = [(rng.randrange(35), say(2), rng.choice([None, -1.0, 0.5])) for _ in range(40)]
    got = retrieval.hybrid(spark.createDataFrame(qs, "query_id int, text string"), spark.createDataFrame(rows, "ticker int, name string, bundle string"), spark.createDataFrame(risks, "query_id int, ticker int, score double"), spark.createDataFrame(news, "ticker int, text string, score double"), 6, 4)
    want = set()
    for q, text in qs:
        qt = set(text.split())
        themes = {k for k, ws in C.fixed.THEMES.items() if any(w in text for w in ws)}
        risk = dict(sorted(((t, s) for a, t, s in risks if a == q and s > 0), key=lambda x: (-x[1], x[0]))[:4])
        scored = []
        for t in {t for t, _, _ in rows} | set(risk):
            bundle = rows[t][2] if t < 30 else ""
            theme = len(themes & {k for k, ws in C.fixed.BUNDLE_THEMES.items() if any(w in bundle for w in ws)}) / max(len(themes), 1)
            aux = max([0.6 * len(qt & set(x.split())) / max(len(qt), 1) + 0.4 * max(s or 0, 0) for n, x, s in news if n == t and qt], default=0)
            scored.append((-round(0.4 * theme + 0.3 * len(qt & set(bundle.split())) / max(len(qt), 1) + 0.25 * risk.get(t, 0) / max([*risk.values(), 1e-6]) + 0.05 * aux, 6), t))
        want |= {(q, t, i + 1) for i, (_, t) in enumerate(sorted(scored)[:6])}
    assert {(r["query_id"], r["ticker"], r["rank"]) for r in got.collect()} == want


def test_questions_of_a_fund(spark):
    said = [
        "Stock code: 2800 HKD counter", "Trading lot size: 500 units on the exchange board", "Base currency: Hong Kong dollars and nothing else at all.",
        "The investment objective is to follow the index closely every day.", "The strategy is full replication of all the constituents held.", "The strategy may rebalance the basket four times a year.",
        "Copyright of this fine document belongs to the manager alone.", "Tracking error can come from fees and from sampling the index.", "Tracking error can come from fees and from sampling the index.", "short",
        "The dividend is paid semi-annually at the discretion of the manager.",
    ]
    d = spark.createDataFrame([("02800", i, t) for i, t in enumerate(said)], "ticker string, pos int, text string")
    rows = api.generate_qa(d, least_chars=20).collect()
    by = {(r["language"], r["question"]): r for r in rows}
    objective = by["en", "What is the investment objective of ETF 02800?"]["answer"]
    assert 2 <= sum(s in objective for s in said[3:6]) <= 3 and all(x in " ".join(said) for x in re.split(r"(?<=\.) ", objective))
    assert by["en", "What causes tracking error in ETF 02800?"]["answer"] == said[7]
    zh = by["zh-HK", "這隻ETF的追蹤誤差主要由甚麼造成（02800）？"]
    assert zh["answer"] == "根據基金文件：" + said[7] and zh["source_tag"] == "single_sentence_zh"
    assert not any("Copyright" in r["answer"] for r in rows) and len({(r["language"], r["question"]) for r in rows}) == len(rows)
    assert sorted(map(str, api.generate_qa(d.repartition(3), least_chars=20).collect())) == sorted(map(str, rows))
    assert api.generate_qa(d, least_chars=20, most=2).count() == 2 and {r["language"] for r in api.generate_qa(d, least_chars=20, bilingual=False).collect()} == {"en"}


def test_side_by_side(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], "0001", ["m"], ["t"]), (2, [0.0, 1.0], "0002", ["m"], ["t"])], "item long, v array<double>, code string, metadata array<string>, tags array<string>")
    q = spark.createDataFrame([(10, [1.0, 0.1], "x", "positive", 0.5)], "query_id long, q array<double>, text string, label string, confidence double")
    gold = spark.createDataFrame([(10, 1)], "query_id long, item long")
    got = {r["corpus"]: (r["top1_precision"], r["topk_recall"]) for r in api.run_side_by_side(q, gold, {"profile": corpus, "sentence": corpus.filter("item = 2")}).collect()}
    assert got == {"profile": (1.0, 1.0), "sentence": (0.0, 0.0)}


def test_writers_read_back(spark, tmp_path):
    v = spark.createDataFrame([("a", "p", 1), ("b", "q", 2), ("c", "p", 3)], "ticker string, perspective string, cluster_id int")
    ingest.write_by(v, str(tmp_path / "v"), "perspective")
    back = spark.read.parquet(str(tmp_path / "v"))
    assert sorted(r["ticker"] for r in back.filter("perspective = 'p'").collect()) == ["a", "c"] and (tmp_path / "v" / "perspective=q").exists()
    pairs_ = spark.createDataFrame([("1", "What?\nNow", "It is \"so\"", "t")], "id string, question string, answer string, tag string")
    ingest.write_records(qa.chatml(pairs_, "s", ["tag"]), str(tmp_path / "j"))
    got = ingest.jsonl_messages(spark, str(tmp_path / "j")).first()
    assert [m["content"] for m in got["messages"]] == ["s", "What?\nNow", "It is \"so\""] and got["metadata"] == {"tag": "t"}
