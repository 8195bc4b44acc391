import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from lodestream.llm import periodic_runs as P
from tests_llm_data import DOCS, as_table, odd_documents


def brute_force(words, least=6, power=4):
    """Every maximal stretch by its smallest period, from all pairs of words."""
    n, found = len(words), {}
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def answer(doc_id, text):
    """The contract, word by word."""
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_force(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_equals_brute_force_on_random_sequences():
    rng = random.Random(4)
    for _ in range(1500):
        ids = []
        while len(ids) < rng.randint(0, 120):
            block = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 9))]
            ids += block * rng.choice([1, 1, 2, 4, 5, 7]) + block[: rng.randint(0, len(block))]
        least, power = rng.choice([(6, 4), (6, 3), (4, 3), (12, 5)])
        assert list(map(tuple, P.find_runs(np.array(ids, dtype=np.int64), least, power).tolist())) == brute_force(ids, least, power)


@pytest.mark.parametrize("ids", [[0] * 300_000, [0, 1, 2] * 100_000, [*range(50_000)] * 6, [*range(200_000)]])
def test_very_long_runs(ids):
    got = P.find_runs(np.array(ids, dtype=np.int64)).tolist()
    period = len(set(ids))
    assert got == ([[0, len(ids), period]] if len(ids) >= 4 * period else [])


def test_names_and_agreement():
    ids = np.array([0, 1, 0, 1, 0, 2, 0, 1, 0, 1])
    levels = P.name_levels(ids)
    i, j = np.triu_indices(len(ids), 1)
    after = lambda a, b: next((x for x in range(len(ids) - b) if ids[a + x] != ids[b + x]), len(ids) - b)
    before = lambda a, b: next((x for x in range(a) if ids[a - 1 - x] != ids[b - 1 - x]), a)
    assert P.agree_after(levels, i, j).tolist() == [after(a, b) for a, b in zip(i, j, strict=True)]
    assert P.agree_before(levels, i, j).tolist() == [before(a, b) for a, b in zip(i, j, strict=True)]


def test_runs_that_overlap_and_nest():
    runs, text = P.collapse(b"x a a a a a a b a a a a a a b a a a a a a b a a a a a a b y\ty\ny y\x0by y z")
    assert runs.tolist() == [[1, 6, 1], [1, 28, 7], [8, 6, 1], [15, 6, 1], [22, 6, 1], [29, 6, 1]]
    assert text == b"x a b y z"


def test_only_ascii_white_space_parts_words():
    runs, text = P.collapse("a b a b a b  a b\x1c c".encode())
    assert not len(runs) and text.decode() == "a b a b a b  a b\x1c c"


def test_query_equals_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text")
    want = [answer(*r) for r in docs.collect() if len(r.text or "") < 20_000]
    got = {r.doc_id: tuple(r) for r in P.op13_periodic_runs(spark, DOCS).collect()}
    assert len(got) == docs.count() and all(got[w[0]] == w for w in want)
    assert sum(w[1] > 0 for w in want) > len(want) / 20
    odd = [(None, "a a a a a a"), (3, None), (4, ""), (5, " \n "), (6, "b " * 9), (6, "b " * 9)] + [(i, " ".join(f"w{k % 11}" for k in range(i))) for i in range(100, 160)]
    sf = as_table(spark, tmp_path, "documents", odd, "doc_id long, text string")
    assert sorted(map(str, map(tuple, P.op13_periodic_runs(spark, sf).collect()))) == sorted(str(answer(*r)) for r in odd)


def test_too_weak_runs_are_refused(spark):
    with pytest.raises(ValueError):
        P.periodic_runs(spark.createDataFrame([("a",)], "text string"), power=2)


def test_odd_tables(spark):
    for docs in odd_documents(spark):
        out = P.periodic_runs(docs)
        assert out.columns == [*docs.columns, "runs", "collapsed"] and out.count() == docs.count()
        assert all((r.text is None) == (r.collapsed is None) and r.runs is not None for r in out.collect())
    own = spark.createDataFrame([("a " * 8, 1, 2)], "text string, Runs int, row int")
    (r,) = P.periodic_runs(own).collect()
    assert (r.row, r.collapsed, len(r.runs)) == (2, "a", 1) and "Runs" not in P.periodic_runs(own).columns
