import base64
import random
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestream.llm import byte_bpe as B
from pyspark.sql import functions as F
from tests_llm_data import DOCS, odd_documents

PATH = public_tokenizers.path(B.RANKS)
RANKS = B.read_ranks(open(PATH, "rb").read())
ENCODER = B.Encoder(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def pack(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def brute_force(piece, ranks):
    """Merge the leftmost pair of lowest rank until no pair has one."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if found is None:
            return [ranks[p] for p in parts]
        parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab \n\té中'ß1!"), st.characters(max_codepoint=0xFFFF, exclude_categories=["Cs", "Cn"])), max_size=80))
def test_equals_the_library(text):
    assert ENCODER.encode(text) == pack(THEIRS.encode_ordinary(text))


def test_equals_brute_force_for_any_ranks():
    """Also where a merge makes a pair of lower rank than its own."""
    rng = random.Random(5)
    for _ in range(200):
        tokens = {bytes([b]) for b in range(256)} | {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(40)}
        order = sorted(tokens)
        rng.shuffle(order)
        ranks = {t: 3 * i for i, t in enumerate(order)}
        bits = B.RankBits(ranks)
        for _ in range(20):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 40)))
            assert B.merge(piece, ranks, bits) == brute_force(piece, ranks)
        assert not any(bits.words)


@pytest.mark.parametrize("text", ["a" * 100_000, "ab" * 50_000, "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=100_000)), " " * 5000, "中文" * 20_000])
def test_very_long_pre_tokens(text):
    assert ENCODER.encode(text) == pack(THEIRS.encode_ordinary(text))


def test_a_full_cache_starts_anew():
    small = B.Encoder(RANKS, public_tokenizers.PATTERN, cache=3)
    text = " ".join(f"word{i % 17}" for i in range(200)) + "x" * 300
    assert small.encode(text) == pack(THEIRS.encode_ordinary(text)) and len(small) <= 3


def test_whole_table_round_trip_and_library(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = B.decode(B.encode(docs, PATH), PATH).select("*", B.unpacked(F.col("ids")).alias("list")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert bytes(r.bytes) == r.text.encode() and r.list == THEIRS.encode_ordinary(r.text)


def test_nulls_odd_ids_and_names(spark):
    df = spark.createDataFrame([(1, None, b"x"), (2, "", b"x"), (3, "a", b"x")], "n int, text string, `IDS` binary")
    out = B.encode(df, PATH)
    assert out.columns == ["n", "text", "ids"] and [r.ids for r in out.orderBy("n").collect()] == [None, b"", pack(THEIRS.encode_ordinary("a"))]
    ids = spark.createDataFrame([(1, None), (2, b""), (3, b"abc"), (4, pack([10**9])), (5, pack([0]))], "n int, ids binary")
    back = B.decode(ids, PATH).select("*", B.unpacked(F.col("ids")).alias("list")).orderBy("n").collect()
    assert [r.bytes for r in back] == [None, b"", None, None, base64.b64decode(open(PATH, "rb").readline().split()[0])]
    assert [r.list for r in back] == [None, [], [], [10**9], [0]]


def test_incomplete_ranks_are_an_error():
    with pytest.raises(ValueError):
        B.read_ranks(base64.b64encode(b"a") + b" 0\n")


def test_odd_tables(spark):
    for docs in odd_documents(spark):
        out = B.decode(B.encode(docs, PATH), PATH)
        assert out.columns == [*docs.columns, "ids", "bytes"] and out.count() == docs.count()
        assert all(r.text is None and r.bytes is None or bytes(r.bytes).decode() == r.text for r in out.collect())
