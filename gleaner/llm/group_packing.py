"""First-fit-decreasing packing in randomised groups of documents, with a tournament tree of bin capacities.

1. Documents are tokenized and cut into pieces of ``size`` ids; only a document's last piece
   may be shorter.  Full pieces are sequences as they are.
2. Each document draws one of the groups, whose number follows the bytes of the corpus, so a
   group is of bounded size however many documents there are.  Groups are packed
   independently of each other: the ids are shuffled once, by group.
3. In a group, pieces come by falling length, and each goes to the first sequence that has
   room for it.  A tournament tree over the sequences in order of opening, whose nodes hold
   the largest room below them, finds it on one way down.
4. What is still open is levelled: documents may be cut, so the emptiest sequences are poured
   into the gaps of the others until those are full.  Less than one sequence of a group is
   left; it is cut into sequences of falling powers of two, which need no padding.

So every sequence is full or as long as a power of two, and a group has about as many cuts as
it had sequences with gaps.

Defined results: a null text is empty and still has its closing id; rows without doc_id are
left out; an empty table gives an empty table; rows that repeat a doc_id are packed each, and
repeated rows draw groups of their own; other columns are ignored; the text of a special token
is that token, as the tokenizer has it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts, whole_groups
from .packing import END_ID, TOKENIZER, _encoder

SIZE = 2048
#: Bytes of text in one group, about.
GROUP_BYTES = 4 << 20
#: Bits of a sequence_id below the group.
WITHIN = 31


class FirstFitTree:
    """A tournament tree over sequences in order of opening; a node holds the largest room below it."""

    def __init__(self, sequences: int, size: int) -> None:
        self.base = 1 << max(0, sequences - 1).bit_length()
        self.room = [size] * (2 * self.base)

    def place(self, length: int) -> int:
        """The first sequence with room for ``length``, which is taken."""
        room, base, at = self.room, self.base, 1
        while at < base:
            at *= 2
            at += room[at] < length
        room[at] -= length
        found = at - base
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return found


def first_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Sequences of positions in ``lengths``, which fall and are at most ``size``."""
    tree, sequences = FirstFitTree(len(lengths), size), []
    for i, length in enumerate(lengths):
        at = tree.place(length)
        if at == len(sequences):
            sequences.append([])
        sequences[at].append(i)
    return sequences


def levelled(sequences: list[list[int]], lengths: list[int], size: int) -> list[list[tuple[int, int, int]]]:
    """``sequences`` as parts (position, start in it, length): full ones, and powers of two from what is left."""
    fills = [sum(lengths[i] for i in s) for s in sequences]
    full = sum(fills) // size
    order = sorted(range(len(sequences)), key=lambda s: -fills[s])
    out = [[(i, 0, lengths[i]) for i in sequences[s]] for s in order[:full]]
    poured = [[i, 0, lengths[i]] for s in reversed(order[full:]) for i in sequences[s]]

    def pour(into: list, n: int) -> None:
        while n:
            part = poured[-1]
            taken = min(n, part[2])
            into.append((part[0], part[1], taken))
            part[1] += taken
            part[2] -= taken
            n -= taken
            if not part[2]:
                poured.pop()

    for s, parts in zip(order, out, strict=False):
        pour(parts, size - fills[s])
    left = sum(fills) - full * size
    while left:
        out.append([])
        pour(out[-1], 1 << (left.bit_length() - 1))
        left &= (1 << (left.bit_length() - 1)) - 1
    return out


def _pieces(docs: DataFrame, size: int, name: str, groups: int, with_ids: bool) -> DataFrame:
    """Pieces with their group; ``ids`` (packed) where they may be cut, or everywhere ``with_ids``."""
    end = struct.pack("<I", END_ID)
    fields = {"part": pa.int64(), "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int32(), "crc": pa.int64(), "doc_tokens": pa.int64(), "nr": pa.int64(), "ids": pa.binary()}
    schema = pa.schema(list(fields.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        width = _width(encoder)
        drawn, row = TaskContext.get().partitionId(), 0
        for b in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.packed(b.column(1).to_pylist()), strict=True):
                ids += end
                row += 1
                for at in range(0, len(ids), 4 * size):
                    piece = ids[at : at + 4 * size]
                    whole = len(piece) == 4 * size
                    draw = xxhash.xxh64_intdigest(struct.pack("<qqqq", doc_id, drawn, row, at if whole else -1))
                    sent = np.frombuffer(piece, "<u4").astype(width).tobytes() if with_ids or not whole else None
                    for column, value in zip(out, (draw % groups, doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, (drawn << 40) + row, sent), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, fields.values(), strict=True)], schema=schema)

    return texts(docs).mapInArrow(run, "part long, doc_id long, start long, length int, crc long, doc_tokens long, nr long, ids binary")


def _width(encoder) -> str:
    """The narrowest type that holds every id of the tokenizer."""
    return "<u2" if encoder.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _packed(group: pa.Table, size: int, width: str, with_ids: bool) -> pa.RecordBatch:
    part, doc_id, start, lengths, crc, doc_tokens = (group.column(i).to_pylist() for i in range(6))
    ids = group.column(7)
    sequences = levelled(first_fit_decreasing(lengths, size), lengths, size)
    out: list[list] = [[] for _ in range(7 + with_ids)]
    for nr, parts in enumerate(sequences):
        offset = 0
        for i, at, n in parts:
            known = crc[i]
            if n != lengths[i] or with_ids:
                held = np.frombuffer(ids[i].as_py(), width)[at : at + n]
                known = known if n == lengths[i] else zlib.crc32(held.astype("<u4").tobytes())
            row = [doc_id[i], start[i] + at, n, known, doc_tokens[i], (part[0] << WITHIN) + nr, offset]
            for column, value in zip(out, row, strict=False):
                column.append(value)
            if with_ids:
                out[7].append(held.astype(np.int32))
            offset += n
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if c != "ids" else pa.list_(pa.int32())) for x, c in zip(out, names, strict=True)], names=names)


def pack_in_groups(docs: DataFrame, size: int = SIZE, name: str = TOKENIZER, with_ids: bool = False, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pieces of ``docs`` with sequence_id and offset: doc_id, start, length, ids_crc32, doc_tokens, and ``ids`` if asked for."""
    small_batches(docs.sparkSession)
    held = docs.where("doc_id is not null").agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    groups = max(1, -(-((held["bytes"] or 0) + 8 * held["rows"]) // group_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(_encoder(name))
        for t in whole_groups(batches, 1):
            key = t.column(0).to_numpy()
            starts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(starts, starts[1:], strict=False):
                yield _packed(t.slice(a, b - a), size, width, with_ids)

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    pieces = _pieces(docs, size, name, groups, with_ids)
    return pieces.repartition("part").sortWithinPartitions("part", F.desc("length"), "doc_id", "start", "nr").mapInArrow(run, ddl)


def op13_group_packing(spark, sf_dir: str) -> DataFrame:
    return pack_in_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_group_packing": op13_group_packing}
ORACLE: dict[str, str] = {}
