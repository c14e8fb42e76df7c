"""Best-fit-decreasing packing of tokenized documents with a segment tree over capacities.

The order of best-fit decreasing depends only on lengths, and a length is at most the
sequence size.  So the whole corpus is packed from a histogram of at most ``size``
lengths: open sequences stand in runs of equal remaining capacity, a segment tree over
the capacities finds the tightest that still fits, and a run takes documents of one
length at once, exactly as they would come one by one.  The plan has a bounded number of
rows whatever the corpus holds.  Each piece then learns its rank among the pieces of its
length from counts by (length, bucket), and its place from the plan.

Defined results: a null text is empty and still has its closing id; only documents longer
than ``size`` are cut; rows without doc_id are left out; an empty table gives an empty
table; rows that repeat a doc_id are packed each; other columns are ignored; the text of a
special token is that token, as the tokenizer has it.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, texts

SIZE = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces in one rank bucket, about.
BUCKET_ROWS = 2000
#: Rows of the plan that are broadcast; a longer plan is joined by its lengths instead.
BROADCAST_ROWS = 200_000
#: Buckets of one length that are added up together.
UPPER = 1024
#: Chunks in one generation of a worker's memory, and the longest chunk that is remembered.
REMEMBERED, LONGEST = 200_000, 64


_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_MARKS = b".,;:!?%&*#$"


class WordEncoder:
    """Ids of whole texts by a word-wise tokenizer, with the ids of recent chunks kept.

    A chunk is what stands between ASCII white space.  The tokenizer drops white space, and
    neither its normal form, nor its lower case, nor its splitting looks across, so the ids
    of a text are those of its chunks.  A chunk of letters below U+0100, which are in normal
    form and have one lower case, with ASCII punctuation behind them is two pieces by the
    tokenizer's pattern and goes to its model as they are; all others are encoded by the
    tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The model sees the bytes of UTF-8 as printable characters: others are moved up, in order.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.shown = dict(zip((b for b in range(256) if b not in printable), range(256, 512), strict=False))
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.marks: dict[bytes, bytes] = {}

    def _modelled(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _learn(self, chunks: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """The chunks with their ids; a word that is known without its marks, or in lower case, isn't modelled again."""
        others, new, old, marks, modelled = [], self.new, self.old, self.marks, self._modelled
        for chunk in chunks:
            word = chunk.rstrip(_MARKS)
            rest = chunk[len(word) :]
            if len(chunk) > LONGEST or not (word.isalpha() or _PLAIN(word.decode())):  # isalpha: ASCII letters
                others.append(chunk)
                continue
            ids = (new.get(word) or old.get(word)) if rest else None
            if ids is None:
                known = word.lower() if word.isascii() else word.decode().lower().encode()
                ids = new.get(known) or old.get(known)
                if ids is None:
                    ids = modelled(known.decode() if known.isascii() else known.decode("latin-1").translate(self.shown))
                    if rest or known != word:
                        new[known] = ids
            if rest:
                if rest not in marks:
                    marks[rest] = modelled(rest.decode())
                ids += marks[rest]
            yield chunk, ids
        encoded = self.tokenizer.encode_batch_fast([c.decode() for c in others], add_special_tokens=False)
        for chunk, e in zip(others, encoded, strict=True):
            yield chunk, array("I", e.ids).tobytes()

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.encode().split() for t in texts]  # bytes: splits at ASCII white space only
        new, old, missing = self.new, self.old, []
        for chunk in set().union(*split).difference(new):
            ids = old.get(chunk)
            if ids is None:
                missing.append(chunk)
            else:
                new[chunk] = ids
        new.update(self._learn(missing))
        out = [b"".join(map(new.__getitem__, chunks)) for chunks in split]
        for chunk in missing:
            if len(chunk) > LONGEST:
                del new[chunk]
        if len(new) >= REMEMBERED:
            self.old, self.new = new, {}
        return out


@lru_cache(maxsize=2)
def _encoder(name: str) -> WordEncoder:
    """Kept by a Python worker from task to task."""
    import public_tokenizers

    return WordEncoder(public_tokenizers.path(name))


def token_pieces(docs: DataFrame, size: int = SIZE, name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Pieces of tokenized documents: doc_id, piece, start, length, ids_crc32, and ``ids`` if asked for."""
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = struct.pack("<I", END_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(name).packed
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    if with_ids:
                        out[5].append(np.frombuffer(part, "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types, strict=True)], schema=schema)

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return texts(docs).mapInArrow(run, ddl)


class CapacityTree:
    """A segment tree over capacities 0..size; a leaf is set while an open sequence has that much room."""

    def __init__(self, size: int) -> None:
        self.base = 1
        while self.base <= size:
            self.base *= 2
        self.any = [False] * (2 * self.base)

    def put(self, capacity: int, there: bool) -> None:
        at = self.base + capacity
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least ``length`` that is set."""
        at = self.base + length
        if self.any[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                while at < self.base:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.base
            at //= 2
        return None


def best_fit_plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Rows (length, first rank, ranks, first sequence, ranks to a sequence, offset): of the
    pieces of a length, rank ``first rank + i`` goes to sequence ``first sequence + i //
    per`` at ``offset + i % per * length``.
    """
    tree = CapacityTree(size)
    open_runs: dict[int, list[tuple[int, int]]] = {}  # capacity: runs (first sequence, how many)
    plan, sequences = [], 0

    def add(capacity: int, first: int, n: int) -> None:
        if capacity and n:
            if capacity not in open_runs:
                open_runs[capacity] = []
                tree.put(capacity, True)
            open_runs[capacity].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = size, sequences
                n = -(-left // (size // length))
                sequences += n
            else:
                first, n = open_runs[room].pop(0)
                if not open_runs[room]:
                    del open_runs[room]
                    tree.put(room, False)
            per = room // length
            taken = min(left, n * per)
            plan.append((length, rank, taken, first, per, size - room))
            full, rest = divmod(taken, per)
            add(room - per * length, first, full)
            if rest:
                add(room - rest * length, first + full, 1)
            add(room, first + full + bool(rest), n - full - bool(rest))
            left -= taken
            rank += taken
    return plan


_PLAN = "length long, from_rank long, n long, first_sequence long, per long, at long"


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (a stored table with doc_id, piece and length 1..size) with sequence_id and offset."""
    spark = pieces.sparkSession
    rows = pieces.count()
    buckets = max(32, -(-rows // BUCKET_ROWS))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    by_bucket = stored(keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    rows_of_plan = best_fit_plan(counts, size)
    plan = spark.createDataFrame(rows_of_plan, _PLAN)
    # Counts before a bucket are summed on two levels, so the most frequent length is no one task's work.
    upper = by_bucket.withColumn("upper", F.floor(F.col("bucket") / UPPER))
    preceding = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    above = upper.groupBy("length", "upper").agg(F.sum("n").alias("n"))
    above = above.select("length", "upper", F.coalesce(F.sum("n").over(preceding("length", "upper")), F.lit(0)).alias("above"))
    inside = F.coalesce(F.sum("n").over(preceding("length", "upper", "bucket")), F.lit(0))
    before = upper.withColumn("inside", inside).join(above, ["length", "upper"]).select("length", "bucket", (F.col("above") + F.col("inside")).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        keyed.withColumn("own", F.row_number().over(own) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("own"))
    )
    if len(rows_of_plan) <= BROADCAST_ROWS:  # in practice a few rows to a length
        plan = F.broadcast(plan)
    placed = ranked.join(plan, (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("from_rank") + F.col("n")))
    i = F.col("rank") - F.col("from_rank")
    return placed.select(
        *(pieces[c] for c in pieces.columns),
        (F.col("first_sequence") + F.floor(i / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.pmod(i, F.col("per")) * pieces["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, size: int = SIZE, name: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``; the pieces are stored once, since they are counted before they are placed."""
    return pack(stored(token_pieces(docs, size, name, with_ids), "pieces"), size)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    found = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
ORACLE: dict[str, str] = {}
