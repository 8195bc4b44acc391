import numpy as np
from lodestream.llm import quality as Q
from pyspark.sql import functions as F
from tests_llm_data import odd_documents

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)
    held = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    got = Q.classify(docs, train).join(held, "doc_id").select("kept", "quality", "toxic").collect()
    clean = [r.kept for r in got if r.quality == 1 and not r.toxic]
    toxic = [r.kept for r in got if r.toxic]
    junk = [r.kept for r in got if r.quality == 0]
    assert sum(clean) / len(clean) > 0.99 and sum(toxic) / len(toxic) < 0.06 and sum(junk) / len(junk) < 0.03


def test_site_posteriors_shrink(spark):
    rows, told = [], []
    for i in range(600):
        site = "bad" if i % 3 == 0 else "good" if i % 3 == 1 else f"rare{i}"
        low = site == "bad" and i % 30 != 0 or site.startswith("rare") and i % 2 == 0
        rows.append((i, "*** buy ||| now ***" if low else "a calm plain text of words", "en", site, 10))
        told.append((i, int(not low), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.source: r.p_site for r in Q.classify(docs, spark.createDataFrame(told, "doc_id long, quality int, toxic int")).join(docs.select("doc_id", "source"), "doc_id").collect()}
    rare = [v for k, v in got.items() if k.startswith("rare")]
    assert got["bad"] < min(rare) and max(rare) < got["good"]


def test_site_posteriors_against_brute_force(spark):
    """The decision of every document from its own evidence and that of all others of its host and path."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = Q.classify(docs, labels).join(docs.select("doc_id", "source", "lang"), "doc_id").collect()
    p = np.array([r.p_doc for r in rows])
    clip = lambda x: np.clip(x, 1e-6, 1 - 1e-6)
    logit = lambda x: np.log(clip(x) / (1 - clip(x)))
    m0 = clip(p.mean())

    def groups(keys):
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        of = np.array([names[k] for k in keys])
        return of, np.bincount(of).astype(float), np.bincount(of, weights=p)

    def strength(n, mean, parent):
        between = (n * (mean - parent) ** 2).sum() / n.sum() - (parent * (1 - parent)).sum() / n.sum()
        v = (n * parent * (1 - parent)).sum() / n.sum()
        return 1e4 if between <= 0 or not v else min(1e4, max(2.0, v / between - 1))

    host, hn, hs = groups([r.source or "" for r in rows])
    path, pn, ps = groups([(r.source or "", r.lang or "") for r in rows])
    parent = np.zeros(len(pn), dtype=int)
    parent[path] = host
    k0 = strength(hn, hs / hn, np.full(len(hn), m0))
    k1 = strength(pn, ps / pn, ((hs + k0 * m0) / (hn + k0))[parent])
    of_host = (hs[host] - p + k0 * m0) / (hn[host] - 1 + k0)
    site = (ps[path] - p + k1 * of_host) / (pn[path] - 1 + k1)
    good = 1 / (1 + np.exp(-np.clip(logit(p) + logit(site) - logit(m0), -30, 30)))
    words = np.array([bool(Q.WORD.findall(t.text or "")) for t in docs.orderBy("doc_id").collect()])
    order = np.argsort([r.doc_id for r in rows])
    good = np.where(words, good[order], 0.0)
    assert np.allclose([rows[i].p_site for i in order], site[order], atol=1e-9)
    assert np.allclose([rows[i].p_good for i in order], good, atol=1e-9) and [rows[i].kept for i in order] == (good >= 0.5).tolist()


def test_logistic_recovers_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3)) * [1, 10, 0.1] + [0, 5, 1]
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [1.0, -0.2, 5.0] - 4)))).astype(float)
    w, b = Q.logistic(x, y)
    assert np.allclose(w, [1.0, -0.2, 5.0], rtol=0.15) and abs(b + 4) < 0.6


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (2, 0, 1), (None, 0, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in odd_documents(spark):
        for told in (labels, labels.limit(0)):
            assert Q.classify(docs, told).count() == docs.count()
        assert Q.keep_good(docs, labels).columns == docs.columns
        assert Q.classify(docs, labels.limit(0)).filter("kept and p_doc = 0").count() == 0
