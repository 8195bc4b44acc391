import hashlib

from lodestream.llm import fingerprints as P
from pyspark.sql import functions as F
from tests_llm_data import DOCS, odd_documents


def test_edited_text_follows_descending_ids(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DOCS}/documents.parquet").collect()}
    ids = sorted(rows, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    got = P.op9_fingerprints(spark, DOCS).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        t, h = rows[r.doc_id], len(rows[r.doc_id]) // 2
        edited = t[: len(t) - h] + rows[after[r.doc_id]][:h]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    mid = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited for r in mid) / len(mid) > 0.2 > 0.1 > sum(r.near_next for r in mid) / len(mid)


def test_ring_of_few_rows_and_ties(spark):
    for ids in ([5], [7, 7], [3, 1, 2], [None, 4], list(range(40))):
        docs = spark.createDataFrame([(i, f"t{n}") for n, i in enumerate(ids)], "doc_id long, text string").repartition(3)
        out = P.with_next(docs, ["text"], parts=5).collect()
        assert len(out) == len(ids) and sorted(r.next_text for r in out) == sorted(r.text for r in out)
    assert P.with_next(spark.createDataFrame([], "doc_id long, text string"), ["text"]).count() == 0


def test_estimates_against_exact_sets(spark):
    base = [f"v{i}" for i in range(6000)]
    pairs = [(" ".join(base), " ".join(base[:n])) for n in (600, 3000, 5400)] + [(" ".join(base[:40]), " ".join(base[:30]))]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.select("a", "b", P.sketch(F.col("a")).alias("x"), P.sketch(F.col("b")).alias("y"))
    sh = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    for r in df.select("a", "b", P.likeness(F.col("x"), F.col("y")).alias("j"), P.containment(F.col("y"), F.col("x")).alias("c")).collect():
        p, q = sh(r.a), sh(r.b)
        assert abs(r.j - len(p & q) / len(p | q)) < 0.12 and abs(r.c - len(p & q) / len(q)) < 0.05
    merged = df.limit(1).select(P.merge(F.col("x"), F.col("y")).alias("m"), "x").first()
    assert merged.m == merged.x


def test_odd_tables(spark):
    for docs in odd_documents(spark):
        out = P.with_next(docs.select("*", P.sketch(F.coalesce("text", F.lit(""))).alias("fp")), ["fp"])
        assert out.select(P.likeness(F.col("fp"), F.col("next_fp"))).count() == docs.count()


def test_query_on_odd_tables(spark, tmp_path):
    for i, docs in enumerate(odd_documents(spark)):
        docs.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        out = P.op9_fingerprints(spark, f"{tmp_path}/{i}").collect()
        assert len(out) == docs.count() and all(r.edited_sha256 and 0 <= r.near_edited <= 1 for r in out)


def test_ranges_spread_null_ids_and_pass_clashing_columns(spark):
    docs = spark.createDataFrame([(None, f"text {i}", i, i, i) for i in range(300)], "doc_id long, text string, k int, `row` int, at int")
    out = P.with_next(docs, ["text"], parts=6)
    assert out.columns == [*docs.columns, "next_text"] and sorted(r.next_text for r in out.collect()) == sorted(f"text {i}" for i in range(300))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange rangepartitioning" in plan and "Exchange hashpartitioning" not in plan
