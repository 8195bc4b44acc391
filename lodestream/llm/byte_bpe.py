"""Byte-level BPE encoding and decoding (operator 12).

A text is cut into pre-tokens by a pattern, and each pre-token is encoded by itself. One that the ranks list is its own
token; any other starts as single bytes, and the adjacent pair of lowest rank is merged, leftmost first, until none is
listed. The pairs wait in a queue with a bucket of positions for every merge rank. A bitmap has one bit a bucket, in words
as wide as they are many, and a bitmap above it one bit a word, so the lowest rank is found by one find-first-set a level.
Tokens are a linked list of positions; an entry whose position was merged away or now starts another pair is stale and
skipped. A pre-token of n bytes takes O(n log n) steps, so one that fills a whole long text is no special case.

Ranks are read on the driver from a file of base64 tokens with their ranks, one a line, and broadcast as these bytes; a file
of more than ``RANKS_BYTES`` is an error. Rows stay in their partition: nothing is shuffled, and a task holds one Arrow
batch and at most ``CACHE`` encoded pre-tokens. Ids travel as packed little-endian unsigned 32-bit integers.

Defined results: a null text or null ids stay null; an empty text has no ids, and no ids decode to no bytes; ids that are
not a multiple of four bytes or name no token decode to null; equal texts have equal ids; an empty table gives an empty
one; the new column is the last, in place of one of that name in any case, and other columns pass through.
"""

from __future__ import annotations

import base64
import os
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import ship, table

RANKS = "byte_bpe_multi_50k.tiktoken"
RANKS_BYTES = 64 << 20
CACHE = 300_000
CACHED_CHARS = 64


class RankBits:
    """The bits of the merge ranks that have a bucket: words of ``width`` bits, all clear between two pre-tokens, and the
    powers of two; beside them the ids of the single bytes, which all have one. The bitmap above is one whole number with a
    bit for each word."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        most = max(ranks.values())
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.shift = max(1, (most.bit_length() + 1) // 2)
        self.width = 1 << self.shift
        self.words = [0] * (most // self.width + 1)
        self.bit = [1 << i for i in range(max(self.width, len(self.words)))]


def merge(piece: bytes, ranks: dict[bytes, int], bits: RankBits) -> list[int]:
    """The ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get, words, bit, shift, low = len(piece), ranks.get, bits.words, bits.bit, bits.shift, bits.width - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # the token at i is piece[i : after[i]]; before[i] starts the one on its left
    ids = [bits.single[b] for b in piece]  # the token that starts at i; -1: none
    pair = [get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]  # rank of the pair that starts at i; -1: none, or i starts no token
    buckets: dict[int, list[int]] = {}
    top = 0
    for i, rank in enumerate(pair):
        if rank >= 0:
            if rank in buckets:
                buckets[rank].append(i)  # in order, which makes it a heap
            else:
                buckets[rank] = [i]
                words[rank >> shift] |= bit[rank & low]
                top |= bit[rank >> shift]
    while top:
        at = (top & -top).bit_length() - 1
        word = words[at]
        rank = at << shift | (word & -word).bit_length() - 1
        bucket = buckets[rank]
        if len(bucket) > 1:
            i = heappop(bucket)
        else:
            i = bucket[0]
            del buckets[rank]
            word &= word - 1
            words[at] = word
            if not word:
                top &= top - 1
        if pair[i] != rank:
            continue
        mid = after[i]
        end = after[i] = after[mid]
        pair[mid] = pair[i] = -1
        ids[i], ids[mid] = rank, -1
        if end < n:
            before[end] = i
            rank = get(piece[i : after[end]], -1)
            if rank >= 0:
                pair[i] = rank
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    words[rank >> shift] |= bit[rank & low]
                    top |= bit[rank >> shift]
        i = before[i]
        if i >= 0:
            rank = pair[i] = get(piece[i:end], -1)
            if rank >= 0:
                if rank in buckets:
                    heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    words[rank >> shift] |= bit[rank & low]
                    top |= bit[rank >> shift]
    return [x for x in ids if x >= 0]


class Encoder(dict):
    """Packed ids by pre-token, worked out when first met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE) -> None:
        self.ranks, self.cache, self.bits = ranks, cache, RankBits(ranks)
        self.find = regex.compile(pattern).findall

    def __missing__(self, piece: str) -> bytes:
        ids = merge(piece.encode(), self.ranks, self.bits)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= self.cache:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.find(text)))


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Rank by token."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, data.splitlines()))}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte needs a rank")
    return ranks


def _broadcast(spark: SparkSession, path: str):
    if os.path.getsize(path) > RANKS_BYTES:
        raise ValueError(f"ranks of more than {RANKS_BYTES} bytes are not broadcast")
    with open(path, "rb") as f:
        data = f.read()
    read_ranks(data)
    return spark.sparkContext.broadcast(data)


def _with(df: DataFrame, name: str, column: Column) -> DataFrame:
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() != name.lower()], column.alias(name))


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", ids_col: str = "ids", pattern: str = public_tokenizers.PATTERN, cache: int = CACHE) -> DataFrame:
    """``df`` with the packed ids of ``text_col``."""
    shared = _broadcast(df.sparkSession, ranks_path)

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(read_ranks(shared.value), pattern, cache)
        for texts in batches:
            yield pd.Series([None if t is None else encoder.encode(t) for t in texts], dtype=object)

    return _with(df, ids_col, packed(df[f"`{text_col}`"].cast("string")))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """``df`` with the bytes that the packed ids of ``ids_col`` stand for."""
    shared = _broadcast(df.sparkSession, ranks_path)

    @F.pandas_udf("binary")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = {rank: token for token, rank in read_ranks(shared.value).items()}

        def one(ids: bytes | None) -> bytes | None:
            if ids is None or len(ids) % 4:
                return None
            try:
                return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
            except KeyError:
                return None

        for batch in batches:
            yield pd.Series([one(x) for x in batch], dtype=object)

    return _with(df, bytes_col, plain(df[f"`{ids_col}`"]))


def unpacked(ids: Column) -> Column:
    """Packed ids as an array<long>."""
    part = lambda i, at: F.conv(F.hex(F.substring(ids, i * 4 + at, F.lit(1))), 16, 10).cast("long")
    n = F.floor(F.length(ids) / 4).cast("int")
    return F.transform(F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), n), lambda i: part(i, 1) + part(i, 2) * 2**8 + part(i, 3) * 2**16 + part(i, 4) * 2**24)


ship(__name__)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of ``documents``, and the bytes they decode to, as digests."""
    path = public_tokenizers.path(RANKS)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = decode(encode(docs, path).drop("text"), path)
    return back.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
