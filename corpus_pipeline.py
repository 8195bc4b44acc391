"""The corpus pipeline: raw ``documents`` to packed batches, each stage written as Parquet and read by the next.

1. quality classifier: documents that it rejects go;
2. line dedup: later copies of repeated runs of lines are cut from the texts; a document of which nothing is left goes;
3. MinHash near-dedup (five words, 0.8): one document of each group stays;
4. mixing: documents repeat at the rates that move the languages toward their target weights;
5. packing: length buckets and batches of everything that is left.

Defined results: documents with a null, empty or wordless text are rejected by the first stage; repeated rows are judged
alike, lose the same lines and stay or go together in near-dedup, as rows of one id are one document; null ids come after
all others and their texts name them; null languages and sources are a site of their own; without labels nothing is
rejected but wordless texts, and mixing knows one domain; an empty table gives no batches; further columns, whatever their
names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import line_dedup, mixing, near_dedup, packing, quality
from lodestream.llm.common import staged, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``n_chars`` follows the new text. A document all of whose lines occur earlier is a copy: it goes."""
    out = line_dedup.dedup_lines(docs).filter((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    row = lambda c: F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c)
    return out.select(*[row(c) for c in docs.columns])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.labelled_domains(docs, table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sized = docs.select("doc_id", packing.n_words(F.col("text")).alias("words"))
    return packing.pack(sized, tokens=F.col("words")).select("row.doc_id", "n_tokens", "bucket", "bucket_len", "batch_id", "slot")


STAGES = [("quality", classify), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mixing", mix), ("packing", pack)]

#: A trained classifier, hashed samples and fitted rates are beyond SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
