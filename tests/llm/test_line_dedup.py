import random

from lodestream.llm import line_dedup as L
from tests_llm_data import odd_documents


def run(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in L.dedup_lines(df, **kw).select("row.doc_id", "text").orderBy("doc_id").collect()]


def test_runs_found_wherever_they_lie(spark):
    run3 = "alpha one\nbeta two\ngamma three"
    texts = [f"p q\n{run3}\nr s", "only\nalpha one\nelse", f"{run3}\ntail of two", f"lead in\nmore lead\n{run3}"]
    assert run(spark, texts) == [texts[0], texts[1], "tail of two", "lead in\nmore lead"]


def test_long_single_line_and_short_ones(spark):
    long = " ".join(f"w{i}" for i in range(60))
    assert run(spark, [f"a\n{long}\nb", f"c\n{long}\nd", "All rights reserved.", "x\nAll rights reserved."]) == [f"a\n{long}\nb", "c\nd", "All rights reserved.", "x\nAll rights reserved."]


def test_every_planted_run_goes_and_every_line_survives_once(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    line = lambda: " ".join(word() for _ in range(5))
    passages = [[line() for _ in range(rng.randint(3, 12))] for _ in range(6)]
    texts, want = [], []
    seen = set()
    for _ in range(60):
        a, b, p = [line() for _ in range(rng.randint(1, 6))], [line() for _ in range(rng.randint(1, 6))], rng.randrange(6)
        texts.append("\n".join(a + passages[p] + b))
        want.append("\n".join(a + ([] if p in seen else passages[p]) + b))
        seen.add(p)
    for window in (1, 2):
        got = run(spark, texts, window=window)
        assert got == want
    assert {x for t in got for x in t.split("\n")} == {x for t in texts for x in t.split("\n")}


def brute_force(texts, window=2, min_words=50):
    """Every run of window + 1 lines, or of min_words words, that occurs earlier."""
    seen, out = set(), []
    for text in texts:
        ls, gone = text.split("\n"), set()
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                run = tuple(ls[i:j])
                if len(run) > window or sum(x.count(" ") + 1 for x in run) >= min_words:
                    if run in seen:
                        gone |= set(range(i, j))
                    seen.add(run)
        out.append("\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


def test_a_run_goes_whole_although_a_part_of_it_occurs_before_both_copies(spark):
    p1, p2, p3 = (" ".join(f"{c}{i}" for i in range(20)) for c in "pqr")
    texts = [f"a\n{p1}\n{p2}\nb", f"c\n{p1}\n{p2}\n{p3}\nd", f"e\n{p1}\n{p2}\n{p3}\nf"]
    assert run(spark, texts) == [texts[0], texts[1], "e\nf"]


def test_equals_brute_force_on_excerpts(spark):
    rng = random.Random(11)
    lines = [" ".join(f"{c}{i}" for i in range(n)) for c, n in zip("abcdefghij", [3, 20, 31, 55, 24, 26, 1, 12, 49, 2], strict=True)]
    texts = []
    for _ in range(80):
        i = rng.randrange(8)
        texts.append("\n".join(rng.choice(lines) if rng.random() < 0.2 else x for x in lines[i : i + rng.randint(1, 7)]))
    for window in (1, 2, 3):
        assert run(spark, texts, window=window) == brute_force(texts, window)


def test_repeats_inside_one_text(spark):
    (got,) = run(spark, ["a b\n" * 50 + "end"])
    assert got.startswith("a b") and got.endswith("end") and got.count("a b") <= 3


def test_fingerprints_are_the_minima_of_windows(spark):
    rng = random.Random(4)
    texts = ["\n".join(" ".join(f"v{rng.randrange(12)}" for _ in range(rng.choice([1, 2, 30]))) for _ in range(rng.randint(1, 30))) for _ in range(20)]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "k long, uid long, text string")
    lines = {x for t in texts for x in t.split("\n")}
    h = dict(spark.createDataFrame([(x,) for x in lines], "x string").selectExpr("x", "xxhash64(x)").collect())
    for window in (1, 2, 4):
        want = {}
        for k, t in enumerate(texts):
            ls = t.split("\n")
            for i in range(len(ls)):
                for n in range(1, window + 2):
                    if i + n <= len(ls) and (n > window or sum(x.count(" ") + 1 for x in ls[i : i + n]) >= 50):
                        pos = min(range(i, i + n), key=lambda p: (h[ls[p]], p))
                        want.setdefault((k, pos, h[ls[pos]]), set()).add((n, i))
        got = {(r.k, r.pos, r.h): {(x.n, x.lo) for x in r.runs} for r in L.fingerprints(df, window).collect()}
        assert got == want


def test_unique_lines_leave_nothing_to_extend(spark):
    df = spark.createDataFrame([(i, i, "\n".join(f"line {i} {j}" for j in range(200))) for i in range(20)], "k long, uid long, text string")
    prints = L.fingerprints(df)
    assert prints.count() < 0.6 * 4000 and L.extended(prints).count() == 0


def test_odd_tables(spark):
    for docs in odd_documents(spark):
        out = L.dedup_lines(docs)
        assert out.count() == docs.count() and out.select("row.*").columns == docs.columns
        assert out.filter("row.text is null and text is not null").count() == 0
