"""Sentences, profiles and other document operators."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lodestream.functions import columns as C
from lodestream.functions import fixed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SENTENCE_END = r"(?<=[.!?;])\s+|(?<=\))\s+(?=\([a-z]\))|(?<=•)\s+"


def sentences(df: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """(key, pos, text): cleaned text cut at sentence ends, pieces over ``least`` characters."""
    cut = df.select(key, F.posexplode(F.split(C.clean_segment(F.col(text)), SENTENCE_END)).alias("pos", "text"))
    return cut.withColumn("text", F.trim("text")).filter(F.length("text") > least)


def merge_fragments(df: DataFrame, key: str, pos: str = "pos", text: str = "text") -> DataFrame:
    """Joins a piece to the one before it unless that ends in . ! ? or a closing quote: gaps and islands."""
    w = Window.partitionBy(key).orderBy(pos)
    before = F.lag(F.substring(text, -1, 1)).over(w)
    marked = df.filter(F.length(text) > 0).select(key, pos, text, F.coalesce(before.isin(".", "!", "?", "”", '"').cast("int"), F.lit(0)).alias("new"))
    island = marked.withColumn("island", F.sum("new").over(w))
    parts = F.array_sort(F.collect_list(F.struct(pos, text)))
    return island.groupBy(key, "island").agg(F.array_join(F.transform(parts, lambda s: s[text]), " ").alias(text)).withColumnRenamed("island", "merged_id")


def first_field(text: Column, patterns: list[str]) -> Column:
    """Value of the first pattern that matches with 3 to 140 characters after stripping."""

    def value(p: str) -> Column:
        v = F.regexp_replace(F.regexp_extract(text, f"(?i){p}", 1), r"^[ .;,:]+|[ .;,:]+$", "")
        return F.when(F.length(v).between(3, 140), v)

    return F.coalesce(*[value(p) for p in patterns])


class _Choice:
    """Greedy choices of one key, row after row: texts whose normal form or first 18 words were seen, short ones, and ones
    over the character budget of their section are skipped. What was seen in one section counts in the next."""

    def __init__(self, key, sections: dict[int, tuple[int, int]], whole: tuple[int, int]):
        self.key, self.sections, self.whole = key, sections, whole
        self.kept: dict[int, list[str]] = {kind: [] for kind in sections}
        self.used = dict.fromkeys(sections, 0)
        self.seen: set[str] = set()

    def full(self, kind: int) -> bool:
        return len(self.kept[kind]) >= self.sections[kind][0]

    def offer(self, kind: int, text: str, norm: str) -> None:
        words = norm.split(" ")
        head = " ".join(words[:18])
        if text and len(words) >= 8 and norm not in self.seen and head not in self.seen and self.used[kind] + len(text) <= self.sections[kind][1]:
            self.kept[kind].append(text)
            self.used[kind] += len(text)
            self.seen |= {norm, head}

    def result(self) -> list[str]:
        """All sections' texts within the count and characters of the whole; over-long ones are skipped."""
        out, used = [], 0
        for t in (t for kind in sorted(self.kept) for t in self.kept[kind]):
            if len(out) < self.whole[0] and used + len(t) <= self.whole[1]:
                out.append(t)
                used += len(t)
        return out


def _choose(sections: dict[int, tuple[int, int]], whole: tuple[int, int], schema: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Choice | None = None
        done: list[_Choice] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c.key for c in done], schema.field(0).type), pa.array([c.result() for c in done], schema.field(1).type)], schema=schema)

        for batch in batches:
            for key, kind, text, norm in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != now.key:
                    done += [now] if now else []
                    now = _Choice(key, sections, whole)
                if kind in sections and not now.full(kind):
                    now.offer(kind, text, norm)
            if len(done) >= 1000:
                yield made()
                done.clear()
        done += [now] if now else []
        if done:
            yield made()

    return work


def choose_ranked(rows: DataFrame, key: str, sections: dict[int, tuple[int, int]], whole: tuple[int, int]) -> DataFrame:
    """(key, kept): per key the greedy choice of each section, best score first, earlier first on ties.

    ``rows`` (key, kind, score, pos, text); ``sections`` gives each kind its number of texts and of characters; rows of
    other kinds only name their key. Rows are dealt by key and sorted, and a task carries nothing over from batch to batch but
    the texts chosen so far, so a key may have any number of rows.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    d = rows.select(F.col(key).alias("key"), "kind", (-F.col("score")).alias("o"), "pos", text.alias("text"), C.normalise_text(text).alias("norm"))
    near = d.repartition("key").sortWithinPartitions("key", "kind", "o", "pos", "text").select("key", "kind", "text", "norm")
    out = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("kept", T.ArrayType(T.StringType()))])
    return near.mapInArrow(_choose(sections, whole, to_arrow_schema(out)), out).select(F.col("key").alias(key), "kept")


def profiles(sents: DataFrame, key: str, weight: Column | None = None, section: tuple[int, int] = (16, 1200), whole: tuple[int, int] = (32, 2600)) -> DataFrame:
    """One profile a key: component and risk sentences by score under budgets, with tags; candidates are not noise and at
    most 420 characters. A key without candidates has an empty profile."""
    clean = sents.filter(~C.is_noise(F.col("text")) & (F.length("text") <= 420))
    scored = clean.select(key, "pos", "text", (C.keyword_score(F.col("text"), fixed.COMPONENT_KEYWORDS)).alias("component"), C.keyword_score(F.col("text"), fixed.RISK_KEYWORDS).alias("risk"), C.risk_focus(F.col("text")).alias("focus"), (F.lit(0) if weight is None else weight).alias("weight"))
    row = lambda kind, s: F.struct(F.lit(kind).alias("kind"), (s + F.col("weight")).alias("score"))
    kinds = F.array(F.when(F.col("component") > 0, row(1, F.col("component"))), F.when((F.col("risk") > 0) & F.col("focus"), row(2, F.col("risk"))))
    # Kind 0 keeps the keys that have no candidate; of these rows no text travels.
    kinds = F.when(F.size(F.array_compact(kinds)) > 0, F.array_compact(kinds)).otherwise(F.array(row(0, F.lit(0))))
    rows = scored.select(key, "pos", "text", F.inline(kinds)).withColumn("text", F.when(F.col("kind") > 0, F.col("text")))
    g = choose_ranked(rows, key, {1: section, 2: section}, whole).withColumn("profile_text", F.array_join("kept", " "))
    return g.select(
        key, "profile_text", F.size("kept").alias("profile_sentence_count"), F.length("profile_text").alias("profile_char_count"),
        F.array_join(C.matching(F.col("profile_text"), fixed.RISK_KEYWORDS), ",").alias("risk_tags"), F.array_join(C.matching(F.col("profile_text"), fixed.COMPONENT_KEYWORDS), ",").alias("component_tags"),
    )
