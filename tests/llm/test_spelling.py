import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from lodestream.llm import spelling as S
from pyspark.sql import functions as F
from tests_llm_data import DOCS, as_table, odd_documents


def edits(word, letters):
    """All words one edit away."""
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cut if b} | {a + c + b[1:] for a, b in cut if b for c in letters} | {a + c + b for a, b in cut for c in letters} - {word}


def answer(rows):
    """The contract over all documents."""
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return groups({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})


def groups(n):
    letters = sorted({c for w in n for c in w})
    near = {w: [x for x in edits(w, letters) if x in n and x != w] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def found(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    out = {r.word: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("limit", [1, 5, S.LIMIT])
def test_equals_brute_force_at_any_limit(spark, limit):
    """Also where every key is hot, so that rests are cut down to one letter."""
    rng = random.Random(limit)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(500)} | {"commonstart" + "".join(rng.choice("abc") for _ in range(5)) for _ in range(80)} | {"a"}
    n = {w: rng.choice([3, 4, 8, 40, 500]) for w in words}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    assert found(S.variant_groups(df, limit)) == groups(n)
    pairs = [tuple(sorted((r.a, r.b))) for r in S.near_pairs(df, limit).collect()]
    assert len(pairs) == len(set(pairs))


def test_long_chain_of_forms(spark):
    n = {"x" * 4 + "abcdefghijklmnopqrst"[:i]: 3 * 2**i for i in range(1, 20)}
    got = found(S.variant_groups(spark.createDataFrame(sorted(n.items()), "word string, n long")))
    assert got == groups(n) and {r[1] for r in got.values()} == {max(n, key=n.get)}


def test_only_ascii_capitals_are_lowered(spark):
    df = spark.createDataFrame([("ÀBCdeÉ",), ("ABÿ×",), ("XYZ",)], "run string")
    assert [r[0] for r in df.select(S.small(F.col("run"))).collect()] == ["ÀbcdeÉ", "abÿ×", "xyz"]


def test_query_equals_brute_force_and_sql(spark):
    rows = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text").collect()
    got = found(S.op11_spelling(spark, DOCS))
    assert got == answer(rows) and any(r[0] for r in got.values()) and any(r[0] != r[1] and r[0] for r in got.values())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DOCS}/documents.parquet'")
    assert {r[0]: (r[1], r[2], *r[3:]) for r in con.sql(S.ORACLE).fetchall()} == got


def test_odd_tables(spark, tmp_path):
    for i, docs in enumerate(odd_documents(spark)):
        rows = docs.select("doc_id", "text").collect()
        sf = as_table(spark, tmp_path / str(i), "documents", docs.collect(), docs.schema)
        assert found(S.op11_spelling(spark, sf)) == answer(rows)
    sf = as_table(spark, tmp_path / "x", "documents", [(None, "Straße straße strasse " * 3), (7, "Größe1größe_GRÖßE größes " * 4)], "doc_id long, text string")
    assert found(S.op11_spelling(spark, sf)) == answer([(None, "Straße straße strasse " * 3), (7, "Größe1größe_GRÖßE größes " * 4)])
