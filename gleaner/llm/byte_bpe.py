"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of parts.  A bucket per merge rank holds the list
positions whose pair has that rank; a two-level bitmap over the ranks tells by
find-first-set which bucket is next.  Merging a pair leaves the old neighbours' entries
in their buckets; such stale entries are skipped when they come up.  A pre-token of n
bytes takes O(n) queue operations, each of constant cost, so very long ones are no
special case.

Each task keeps the ids of recent pre-tokens in two generations of bounded size; the
result does not depend on them.

Defined results: a null text counts as empty and has no ids; whole texts are encoded,
special-token strings are ordinary text; rows without doc_id are left out; an empty table gives
an empty table; columns other than ``doc_id`` and ``text`` are ignored, and repeated rows are
encoded each.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches, texts

#: Pre-tokens in one generation of a worker's memory of encoded pre-tokens.
REMEMBERED = 400_000
#: Characters of the longest pre-token that is remembered.
LONGEST = 64


#: A character outside the Basic Multilingual Plane.
_ASTRAL = re.compile("[^\x00-\uffff]")


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """A function that finds all matches of ``pattern`` in a text.

    For texts inside the Basic Multilingual Plane the pattern is compiled for the
    standard ``re``, its Unicode classes spelled out as ranges taken from ``regex``;
    that is several times faster there.  Other texts go through ``regex`` itself.
    """
    chars = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))

    def ranges(cls: str) -> str:
        return "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(f"{cls}+", chars))

    plain = pattern
    for cls in (r"\p{L}", r"\p{N}", r"\s"):
        inside = ranges(cls)
        plain = re.sub(r"\[[^\]]*\]", lambda m, c=cls, r=inside: m[0].replace(c, r), plain)
        plain = plain.replace(cls, f"[{inside}]")
    fast = re.compile(plain.replace(r"\S", f"[{ranges(r'\S')}]")).findall
    whole = regex.compile(pattern).findall
    outside = _ASTRAL.search
    return lambda text: whole(text) if outside(text) else fast(text)


class RankQueueBPE:
    """Encodes single pre-tokens by merge ranks, without special tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        #: The queue, empty between two pre-tokens: a bucket per rank, a bit per rank in words of 256, a bit per word.
        self.buckets: list[list[int] | None] = [None] * len(self.tokens)
        self.low = [0] * (len(self.tokens) // 256 + 1)
        self.bit = [1 << i for i in range(max(256, len(self.low)))]
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        #: The rank that two neighbouring parts have as one, by left id * 2^32 + right id.
        self.merged: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.merged[left << 32 | right] = rank

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        single, rank_of = self.single, self.merged.get
        part = [single[b] for b in piece]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair = [rank_of(a << 32 | b, -1) for a, b in zip(part, part[1:], strict=False)]
        pair.append(-1)  # pair[i]: the rank of the pair that begins at i, as it is now
        buckets, low, bit = self.buckets, self.low, self.bit
        top = 0
        for i, r in enumerate(pair):
            if r >= 0:
                held = buckets[r]
                if held is None:
                    buckets[r] = [i]
                    low[r >> 8] |= bit[r & 255]
                    top |= bit[r >> 8]
                else:
                    held.append(i)
        while top:
            high = (top & -top).bit_length() - 1
            bits = low[high]
            first = bits & -bits
            low[high] = bits ^ first
            if bits == first:
                top ^= bit[high]
            r = (high << 8) + first.bit_length() - 1
            held = buckets[r]
            buckets[r] = None
            if len(held) > 1:
                held.sort()  # of equal ranks the leftmost is merged first
            for i in held:
                if pair[i] != r:
                    continue  # stale
                part[i] = r
                j = after[i]
                pair[j] = -1
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    pair[i] = q = rank_of(r << 32 | part[k], -1)
                    if q >= 0:
                        if buckets[q] is None:
                            buckets[q] = [i]
                            low[q >> 8] |= bit[q & 255]
                            top |= bit[q >> 8]
                        else:
                            buckets[q].append(i)
                else:
                    pair[i] = -1
                h = before[i]
                if h >= 0:
                    pair[h] = q = rank_of(part[h] << 32 | r, -1)
                    if q >= 0:
                        if buckets[q] is None:
                            buckets[q] = [h]
                            low[q >> 8] |= bit[q & 255]
                            top |= bit[q >> 8]
                        else:
                            buckets[q].append(h)
        ids, i = [], 0
        while i < n:
            ids.append(part[i])
            i = after[i]
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}


class Remembered(dict):
    """Pre-token to its ids as packed bytes; two generations of bounded size, and nothing longer than ``LONGEST`` characters."""

    def __init__(self, encode, most: int = REMEMBERED) -> None:
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, token: str) -> bytes:
        found = self.old.get(token)
        if found is None:
            ids = self.encode(token)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) > LONGEST:
            return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[token] = found
        return found


@lru_cache(maxsize=2)
def _coder(name: str) -> tuple:
    """Kept by a Python worker from task to task."""
    import public_tokenizers

    bpe = RankQueueBPE(read_ranks(public_tokenizers.path(name)))
    sizes = np.fromiter(map(len, bpe.tokens), np.int64, len(bpe.tokens))
    return splitter(public_tokenizers.PATTERN), Remembered(lambda token: bpe.encode(token.encode())), bpe.tokens, sizes


def encode_text(text: str, name: str) -> bytes:
    """The ids of a whole text as little-endian unsigned 32-bit integers."""
    find, memory, _, _ = _coder(name)
    return b"".join(map(memory.__getitem__, find(text)))


def decode_ids(ids: np.ndarray, name: str) -> bytes:
    tokens = _coder(name)[2]
    return b"".join(map(tokens.__getitem__, ids.tolist()))


#: The rank file of the production query.
RANKS = "byte_bpe_multi_50k.tiktoken"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id and ``ids`` (array of int), for each document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [encode_text(t, name) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            values = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id and ``text_bytes``, for rows of doc_id and ``ids``."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [decode_ids(np.asarray(i or [], np.int64), name) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "text_bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text_bytes binary")


def round_trip(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """Encode and decode each text in one task pass and keep the digests."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in b.column(1).to_pylist():
                packed = encode_text(text, name)
                counts.append(len(packed) // 4)
                ids_sha.append(hashlib.sha256(packed).hexdigest())
                text_sha.append(hashlib.sha256(decode_ids(np.frombuffer(packed, "<u4"), name)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], schema=_DIGEST)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_byte_bpe": op4_byte_bpe}
ORACLE: dict[str, str] = {}
