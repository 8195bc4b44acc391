import itertools
import random

from lodestream.llm import packing as K
from tests_llm_data import odd_documents


def padding(hist, bounds):
    return sum(n * (min(b for b in bounds if b >= t) - t) for t, n in hist)


def test_bounds_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        hist = [(t, rng.randint(1, 50)) for t in sorted(rng.sample(range(0, 300), rng.randint(1, 11)))]
        k = rng.randint(1, 4)
        least = min(padding(hist, (*c, hist[-1][0])) for r in range(k) for c in itertools.combinations([t for t, _ in hist], r))
        assert padding(hist, K.optimal_bounds(hist, k)) == least


def check(rows, budget):
    batches = {}
    for r in rows:
        batches.setdefault(r.batch_id, []).append(r)
    for b in batches.values():
        assert len({x.bucket for x in b}) == 1 and sorted(x.slot for x in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket_len <= budget
        assert all(x.n_tokens <= x.bucket_len for x in b)
    by_bucket = {}
    for i, b in batches.items():
        by_bucket.setdefault(b[0].bucket, []).append((i, len(b), max(1, budget // max(1, b[0].bucket_len))))
    for bs in by_bucket.values():  # all batches but the last of a bucket are full
        assert all(n == per for _, n, per in sorted(bs)[:-1])


def test_batches_are_full_and_whole(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("w" * 1 for _ in range(rng.choice([0, 1, 3, 50, rng.randint(1, 400)])))) for i in range(700)] + [(900, "w " * 2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = K.pack(df, buckets=5, budget=1000).collect()
    assert len(rows) == len(docs)
    assert all(r.n_tokens == len((r.row.text or "").split()) for r in rows)
    check(rows, 1000)


def test_odd_tables(spark):
    for docs in odd_documents(spark):
        rows = K.pack(docs, buckets=3, budget=500).collect()
        assert len(rows) == docs.count()
        check(rows, 500)
