"""The greedy choice of ranked texts over sorted streams."""

import random
import re

from lodestream.operators import text
from pyspark.sql import functions as F

SCHEMA = "k string, kind int, score int, pos int, text string"


def brute_force(rows, sections, whole):
    out = {}
    for k in {r[0] for r in rows}:
        seen, kept = set(), []
        for kind, (limit, budget) in sorted(sections.items()):
            mine, used = [], 0
            for _, _, _, t in sorted((-s, p, t, t) for kk, kd, s, p, t in rows if kk == k and kd == kind):
                t = (t or "").strip(" ")
                norm = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", t.lower())).strip()
                words = norm.split(" ")
                head = " ".join(words[:18])
                if t and len(mine) < limit and len(words) >= 8 and not {norm, head} & seen and used + len(t) <= budget:
                    mine.append(t)
                    used += len(t)
                    seen |= {norm, head}
            kept += mine
        final = []
        for t in kept:
            if len(final) < whole[0] and sum(map(len, final)) + len(t) <= whole[1]:
                final.append(t)
        out[k] = final
    return out


def test_equals_brute_force(spark):
    rng = random.Random(8)
    said = [" ".join(rng.choice(["Alpha", "beta,", "gamma", "rho", "tau"]) for _ in range(rng.choice([3, 7, 8, 9, 20, 25]))) for _ in range(25)]
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(3), rng.randint(1, 4), i, rng.choice([*said, " " + said[0], ""])) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for sections, whole in (({1: (3, 200), 2: (4, 300)}, (5, 350)), ({1: (16, 1200), 2: (16, 1200)}, (32, 2600)), ({1: (0, 0), 2: (2, 60)}, (1, 60))):
        got = {r.k: r.kept for r in text.choose_ranked(df, "k", sections, whole).collect()}
        assert got == brute_force(rows, sections, whole)
    assert text.choose_ranked(df.filter("false"), "k", {1: (1, 1)}, (1, 1)).count() == 0


def test_one_key_with_many_rows(spark):
    many = spark.range(300_000).select(F.lit("hot").alias("k"), F.lit(1).alias("kind"), (F.col("id") % 1000).cast("int").alias("score"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("one two three four five six seven eight "), "id").alias("text"))
    rows = text.choose_ranked(many, "k", {1: (3, 1000)}, (3, 1000)).collect()
    assert [r.k for r in rows] == ["hot"] and [t.split()[-1] for t in rows[0].kept] == ["999", "1999", "2999"]


def test_profiles_keep_keys_without_candidates(spark):
    df = spark.createDataFrame([(1, 0, "nothing of note here at all today"), (2, 0, "The index futures strategy has market risk and liquidity risk for all of its holders")], "doc long, pos int, text string")
    got = {r.doc: r for r in text.profiles(df, "doc").collect()}
    assert set(got) == {1, 2} and got[1].profile_text == "" and got[1].profile_sentence_count == 0 and got[2].profile_sentence_count == 1
