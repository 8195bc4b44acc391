import random
import re

import numpy as np
from lodestream.llm import near_dedup as N
from tests_llm_data import DOCS, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def brute(rows, size, pct):
    sets = {i: shingles(t, size) for i, t in rows}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= pct * max(len(x), len(y)):
                i = len(x & y)
                if 100 * i >= pct * (len(x) + len(y) - i):
                    p, q = top(a), top(b)
                    up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i)) for i in ids}


def planted(n=400, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeF") for _ in range(4))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.5 or len(texts) < 5:
            t = [word() for _ in range(rng.choice([0, 1, 2, 3, 20, 120, 300]))]
        else:
            t = rng.choice(texts[-40:]).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 9])):
                if t:
                    t[rng.randrange(len(t))] = word()
            t = [x.upper() for x in t] if kind > 0.9 else t
        texts.append("\x0b\t".join(t) if kind > 0.95 else " ".join(t))
    return list(enumerate(texts))


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.k: (r.n_shingles, r.component_id) for r in N.near_groups(df, **kw).collect()}


def test_components_match_brute_force(spark, monkeypatch):
    rows = planted()
    assert run(spark, rows, size=3, similarity=0.85, bands=20) == brute(rows, 3, 85)
    monkeypatch.setattr(N, "BLOCK", 3)  # many block pairs in a bucket
    assert run(spark, rows, size=5, similarity=0.8) == brute(rows, 5, 80)


def test_chain_and_hot_group(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 14)):
            t[rng.randrange(400)] = f"x{rng.random()}"
        rows.append((i, " ".join(t)))
    at = list(base)
    for i in range(150, 200):  # a chain whose ends are unlike
        for _ in range(6):
            at[rng.randrange(400)] = f"y{rng.random()}"
        rows.append((i, " ".join(at)))
    assert run(spark, rows, size=3, similarity=0.85, bands=20) == brute(rows, 3, 85)


def test_sample_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DOCS}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.op8_near_dedup(spark, DOCS).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows, 3, 85).items()}


def test_odd_sketch_keeps_alike_and_drops_unlike():
    rng = np.random.default_rng(0)
    new = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    apart = lambda x, y: int(np.bitwise_count((N.odd_sketch(x) ^ N.odd_sketch(y)).view(np.uint64)).sum()) - N.most_bits(max(len(x), len(y)), 0.85)
    for size in (7, 60, 150, 400, 1000, 4000):
        for j in (0.85, 0.9, 0.97):
            for _ in range(150):
                shared = new(size)
                more = int(size / j) - size
                x, y = (np.unique(np.concatenate([shared, part])) for part in np.split(new(more), [more // 2]))
                assert apart(x, y) <= 0
    for size in (300, 3000):
        shared = new(size // 2)
        x, y = (np.unique(np.concatenate([shared, new(size // 2)])) for _ in range(2))
        assert apart(x, y) > 0


def test_odd_tables(spark):
    for docs in odd_documents(spark):
        out = N.drop_near_copies(docs)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert N.near_groups(docs).count() == docs.count()
    same = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (2, "u v w x y z"), (3, "a b c d e f")], "doc_id long, text string")
    assert {(r.k, r.component_id) for r in N.near_groups(same).collect()} == {(1, 1), (2, 1), (3, 1)}
