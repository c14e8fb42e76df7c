"""Exact deduplication by Grace hashing.

Level 0 is Spark's own shuffle: each distinct text of an input task goes to the
partition of its hash.  Before that shuffle every task merges the copies that it reads
itself, so a text of which a third of all rows are copies reaches its partition once
per task and table fill, not once per row.  Inside a partition the records stream into
an open-addressing table that compares complete contents; if the table outgrows
``table_bytes``, its records and the rest are written to ``fan_out`` spill files by the
next bits of the hash, and each file is treated the same way with the bits after those.

Defined results: a null text counts as empty; all empty texts are copies of each other;
of copies the largest ``doc_id`` stays; an empty table gives an empty table; columns other
than ``doc_id`` and ``text`` are ignored; rows without doc_id are left out; rows that
repeat a doc_id give a row each.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import one_row_each, small_batches, stored, texts

TABLE_BYTES = 48 << 20
FAN_OUT = 16
BITS = 4
DEEPEST = 14

_LOCAL = "doc_id long, rep_id long, h long, text string, n long, top_id long"
_LOCAL_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("rep_id", pa.int64()), ("h", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("top_id", pa.int64())]
)
_CLASS = "rep_id long, keep_id long, group_size long, text_sha256 string"
_CLASS_ARROW = pa.schema([("rep_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


class ContentTable:
    """Open addressing with linear probing; a slot holds an entry's number, entries hold whole contents."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.held = 0

    def find(self, h: int, content: bytes) -> tuple[int, bool]:
        """The number of the entry with this content, and whether it is new."""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 29)) & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                return entry, False
            at = (at + 1) & mask
        entry = self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.held += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry, True

    def _grow(self) -> None:
        mask = 2 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for entry, h in enumerate(self.hashes):
            at = (h ^ (h >> 29)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _merge_local(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[pa.RecordBatch]:
    """Per input row (doc_id, rep_id); a representative's row also has text, count and largest id."""
    table, reps, ids, counts, tops = ContentTable(), [], [], [], []
    number = TaskContext.get().partitionId() << 33

    def flush() -> Iterator[pa.RecordBatch]:
        step = 256
        for i in range(0, len(reps), step):
            part = slice(i, i + step)
            signed = [h - (1 << 64) if h >> 63 else h for h in table.hashes[part]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip((ids[part], reps[part], signed, [c.decode() for c in table.contents[part]], counts[part], tops[part]), _LOCAL_ARROW.types, strict=True)],
                schema=_LOCAL_ARROW,
            )

    for batch in batches:
        members: tuple[list, list] = ([], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            content = text.encode()
            entry, new = table.find(xxhash.xxh64_intdigest(content), content)
            if new:
                number += 1
                reps.append(number)
                ids.append(doc_id)
                counts.append(1)
                tops.append(doc_id)
            else:
                counts[entry] += 1
                tops[entry] = max(tops[entry], doc_id)
                members[0].append(doc_id)
                members[1].append(reps[entry])
        if members[0]:
            n = len(members[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(members[0], pa.int64()), pa.array(members[1], pa.int64()), *(pa.nulls(n, t) for t in _LOCAL_ARROW.types[2:])], schema=_LOCAL_ARROW
            )
        if table.held > table_bytes:
            yield from flush()
            table, reps, ids, counts, tops = ContentTable(), [], [], [], []
    yield from flush()


def _grace(records: Iterator[tuple], table_bytes: int, level: int, folder: str) -> Iterator[tuple]:
    """Classes of ``records`` (h, content, rep_id, n, top_id) as (rep_ids, keep_id, group_size, content)."""
    table, reps, counts, tops = ContentTable(), [], [], []
    files: list = []
    taken = iter(records)
    for h, content, rep_id, n, top_id in taken:
        entry, new = table.find(h, content)
        if new:
            reps.append([rep_id])
            counts.append(n)
            tops.append(top_id)
        else:
            reps[entry].append(rep_id)
            counts[entry] += n
            tops[entry] = max(tops[entry], top_id)
        if table.held > table_bytes and len(table.contents) > 1 and level < DEEPEST:
            files = [tempfile.NamedTemporaryFile(dir=folder, delete=False) for _ in range(FAN_OUT)]
            break
    if not files:
        yield from zip(reps, tops, counts, table.contents, strict=True)
        return
    shift = 60 - BITS * level

    def spill(h: int, record: tuple) -> None:
        pickle.dump(record, files[(h >> shift) & (FAN_OUT - 1)], pickle.HIGHEST_PROTOCOL)

    for h, content, ids, n, top_id in zip(table.hashes, table.contents, reps, counts, tops, strict=True):
        spill(h, (h, content, ids[0], n, top_id))
        for rep_id in ids[1:]:
            spill(h, (h, content, rep_id, 0, top_id))
    del table, reps, counts, tops
    for record in taken:
        spill(record[0], record)

    def read(path: str) -> Iterator[tuple]:
        with open(path, "rb") as f:
            while f.peek(1):
                yield pickle.load(f)

    for f in files:
        f.close()
    for f in files:
        yield from _grace(read(f.name), table_bytes, level + 1, folder)
        os.unlink(f.name)


def _classes(batches: Iterator[pa.RecordBatch], table_bytes: int) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[tuple]:
        for b in batches:
            for h, text, rep_id, n, top_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield h & 0xFFFFFFFFFFFFFFFF, text.encode(), rep_id, n, top_id

    out: tuple[list, list, list, list] = ([], [], [], [])

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _CLASS_ARROW.types, strict=True)], schema=_CLASS_ARROW)

    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for ids, keep_id, size, content in _grace(records(), table_bytes, 0, folder):
            sha = hashlib.sha256(content).hexdigest()
            for rep_id in ids:
                for column, value in zip(out, (rep_id, keep_id, size, sha), strict=True):
                    column.append(value)
            if len(out[0]) >= 4096:
                yield batch()
                out = ([], [], [], [])
    yield batch()


def exact_classes(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The table of local copies is stored once, because both the classes and the rows that
    point to them come from it.
    """
    small_batches(docs.sparkSession)
    local = stored(texts(docs).mapInArrow(lambda it: _merge_local(it, table_bytes), _LOCAL), "grace")
    classes = (
        local.where("text is not null")
        .select("h", "text", "rep_id", "n", "top_id")
        .repartition("h")
        .mapInArrow(lambda it: _classes(it, table_bytes), _CLASS)
    )
    return (
        local.select("doc_id", "rep_id")
        .join(classes, "rep_id")
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each text, that of the largest doc_id, with all its columns; of rows that repeat doc_id and text one stays."""
    keep = exact_classes(docs).where("kept").select("doc_id", F.col("text_sha256").alias("row")).distinct()
    return one_row_each(docs, keep, lambda text: F.sha2(text, 256))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
