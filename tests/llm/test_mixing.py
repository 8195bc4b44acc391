import math

import numpy as np

from lodestream.llm import mixing as M
from lodestream.llm.packing import n_words
from pyspark.sql import functions as F
from tests_llm_data import DOCS, odd_documents


def brute_rates(p, w, targets, rounds=4000):
    have = w @ p
    r = np.ones(len(w))
    for _ in range(rounds):
        r = np.maximum(0, r - p @ ((w * r) @ p / have - targets / have))
    return r


def test_rates_match_numpy_and_meet_targets(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.3] * 3, 400)
    p = np.round(p * 32)
    p = p / p.sum(axis=1, keepdims=True)
    w = rng.integers(1, 500, 400).astype(float)
    have = w @ p
    goal = np.array([0.2, 0.5, 0.3])
    groups = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(p, w, strict=True)], "p array<double>, w double")
    steps, now, wanted = M.fit_rates(groups, ["a", "b", "c"], dict(zip("abc", goal.tolist(), strict=True)), budget=float(w.sum()))
    assert np.allclose(wanted, goal * w.sum()) and np.allclose(now, wanted, rtol=1e-5)
    got = np.array([r.r for r in groups.select(M.rate_of(F.col("p"), steps).alias("r")).collect()])
    assert (got >= 0).all() and np.allclose((w * got) @ p, wanted, rtol=1e-5)
    want = brute_rates(p, w, np.array(wanted))
    assert np.allclose((w * want) @ p, wanted, rtol=1e-5) and np.abs(got - want).mean() < 0.02 and have.sum() > 0


def test_unreachable_target_stays_nonnegative(spark):
    groups = spark.createDataFrame([([0.5, 0.5], 100.0), ([1.0, 0.0], 50.0)], "p array<double>, w double")
    steps, now, _ = M.fit_rates(groups, ["a", "b"], {"a": 0.0, "b": 1.0}, budget=100.0)
    rates = [r.r for r in groups.select(M.rate_of(F.col("p"), steps).alias("r")).collect()]
    assert min(rates) == 0.0 and rates[0] > 0 and now[1] < 100


def test_posteriors_find_the_language_and_copies_follow_rates(spark):
    sf = "/root/testdata/sf0.01"  # with labels enough for the words of four languages
    got = M.op3_mixing(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.n_tokens > 20]
    assert len(got) == 1000 and sum(r.domain == r.lang for r in held) / len(held) > 0.95
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    docs = spark.read.parquet(f"{DOCS}/documents.parquet")
    labels = spark.read.parquet(f"{DOCS}/labels.parquet")
    mixed = M.mix(docs, M.labelled_domains(docs, labels))
    assert mixed.columns == docs.columns and mixed.select("doc_id").distinct().count() == docs.filter("length(trim(text)) > 0").count()
    even = {d: 0.25 for d in ("de", "en", "es", "fr")}
    tokens = M.mix(docs, M.labelled_domains(docs, labels), targets=even, budget=60_000.0).groupBy("lang").agg(F.sum(n_words(F.col("text"))).alias("t")).collect()
    assert all(7_000 < r.t < 23_000 for r in tokens)


def test_posteriors_of_three_subjects_match_brute_force(spark):
    """Domains that are no languages: texts of three subjects with common words, labels for a half, mixed texts among them."""
    rng = np.random.default_rng(5)
    own = {d: [f"{d}{i}" for i in range(40)] for d in ("law", "cooking", "sport")}
    every = [f"common{i}" for i in range(60)]
    rows, told = [], []
    for i in range(300):
        d = ["law", "cooking", "sport"][i % 3]
        ws = [str(rng.choice(own[d] if rng.random() < 0.3 else every)) for _ in range(int(rng.integers(1, 60)))]
        if i % 10 == 9:  # half of one subject, half of another
            ws = [*own["law"][:10], *own["sport"][:10]]
        rows.append((i, "\n".join([" ".join(ws[:5]), "  ".join(ws[5:])])))
        if i % 2 == 0:
            told.append((i, d))
    docs = spark.createDataFrame([*rows, (900, ""), (901, None)], "doc_id long, text string")
    labels = spark.createDataFrame([*told, (900, "law")], "doc_id long, domain string")
    scored, domains, _, _, _ = M.plan(docs, labels)
    got = {r.id: (r.t, r.p) for r in scored.select(F.col("row.doc_id").alias("id"), "t", "p").collect()}
    texts = {i: (t or "").lower().split() for i, t in [*rows, (900, ""), (901, None)]}
    vocabulary = sorted({w for ws in texts.values() for w in ws})
    place = {r.w: r.b for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", M.hashed(F.array("w"))[0].alias("b")).collect()}
    assert domains == ["cooking", "law", "sport"]
    told = dict([*told, (900, "law")])
    counts = np.zeros((3, M.BUCKETS))
    for i, d in told.items():
        for w in texts[i]:
            counts[domains.index(d), place[w]] += 1
    every = counts.sum(axis=0)
    base, a = (every + 1) / (every.sum() + M.BUCKETS), M.SMOOTHING
    rates = np.where(every > 0, np.log((counts + a * base) / (counts.sum(axis=1, keepdims=True) + a)), np.log(base))
    prior = np.array([math.log(sum(d == x for x in told.values()) / len(told)) for d in domains])
    right = 0
    for i, ws in texts.items():
        s = prior + min(1.0, M.HITS / max(1, len(ws))) * sum((rates[:, place[w]] for w in ws), np.zeros(3))
        e = np.exp(s - s.max())
        q = np.floor(e / e.sum() * M.GRID + 0.5)
        assert got[i][0] == len(ws) and np.allclose(got[i][1], q / q.sum(), atol=1.01 / M.GRID), i
        right += i < 300 and i % 10 != 9 and domains[int(np.argmax(got[i][1]))] == ["law", "cooking", "sport"][i % 3]
    assert right > 0.8 * 270 and max(got[9][1]) < 0.75


def test_many_domains_and_rounds(spark):
    """64 domains on 500 documents; the plan of a late round is no larger than that of an early one."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(str(rng.choice([f"d{i % 64}w{n}" for n in range(30)] + [f"common{n}" for n in range(20)])) for _ in range(60))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, f"domain{i % 64:02}") for i in range(320)], "doc_id long, domain string")
    even = {f"domain{n:02}": 1.0 for n in range(64)}
    even["domain05"] = 0.0
    scored, domains, rate, now, wanted = M.plan(docs, labels, targets=even, scale=1.0)
    assert len(domains) == 64 and wanted[5] == 0 and abs(sum(wanted) - 30_000) < 1e-6
    got = scored.select("row.doc_id", "t", "p", rate(F.col("p")).alias("r")).collect()
    p, w, r = np.array([x.p for x in got]), np.array([x.t for x in got], dtype=float), np.array([x.r for x in got])
    assert np.allclose((w * r) @ p, now) and r.min() == 0.0
    want = brute_rates(p, w, np.array(wanted), rounds=M.ROUNDS)
    assert np.allclose(r, want, atol=1e-9)


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (2, "b")], "doc_id long, domain string")
    for docs in odd_documents(spark):
        for told in (labels, labels.limit(0)):
            out = M.mix(docs, told)
            assert out.columns == docs.columns and out.count() >= 0
    assert M.mix(docs, labels.limit(0)).count() == docs.count()
