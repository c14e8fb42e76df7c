"""Substring dedup with a log-structured index of fingerprints.

A word goes if a window of 50 consecutive words that covers it also starts in a document
with a smaller doc_id.  Documents come in batches of ascending doc_id.

The index is a folder of sorted immutable runs, dealt by gram hash into buckets of a bucketed
table: of each context (see ``passages``) it holds the first document and place, in the order
of (gram hash, context hash).  A batch is dealt into the same buckets and merge-joined with
the runs where they lie, which are not shuffled again.  Every hit is verified: what seems equal
is compared by 128-bit digests of the words, and where contexts differ around a shared gram the
words themselves are, new ones with historical ones.  What is new becomes
a run; when there are more than ``most_runs``, they are merged into one in a new version of
the table.  A manifest in the folder names the version in force, so an index can be opened
again, in another session too, and go on with later batches.

Defined results: a null text has no words; words are ``[^\\x20\\x09-\\x0D]+``, unchanged;
documents of fewer than 50 words stay whole; rows without doc_id are left out; rows that
share a doc_id do not count as earlier to each other and keep words of their own, by a hash
of their text; an empty table gives an empty table; other columns are ignored, or handed on
in a struct ``carried``.  Incremental use needs batches in ascending doc_id; a document that
comes later with a smaller doc_id is judged only against what the index has.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, parts, small_batches, stored, texts, whole_groups
from .passages import ANCHORS, HISTORY, PACKED, SPANS, Requests, Rows, _pack, _rows, _spans, _steps, anchors, buckets, cut, entries, merged, shared

GRAM = 25
BATCHES = 4
MOST_RUNS = 2
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_RUN = "part int, run int, payload binary"

_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_TEXT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def _payload(f: np.ndarray, c: np.ndarray, d: np.ndarray, r: np.ndarray, p: np.ndarray, *halves: np.ndarray) -> bytes:
    """Entries in the order of (gram hash, context hash), of equal ones the first document and place."""
    order = np.lexsort((p, r, d, c, f))
    f, c, d, r, p, *halves = (x[order] for x in (f, c, d, r, p, *halves))
    new = np.r_[True, (f[1:] != f[:-1]) | (c[1:] != c[:-1])]
    return _pack(f[new], c[new], _steps(d[new]), r[new], p[new], *(x[new] for x in halves))


def _merge_join(batch: pa.Table, runs: pa.Table, doc_buckets: int) -> pa.Table:
    """One bucket of a batch against all runs: requests of the holders of shared grams, and the new run."""
    out: Rows = ([], [], [])
    ask = Requests(doc_buckets)
    kinds, payloads = batch.column("kind").to_numpy(), batch.column("payload").to_pylist()
    if spans := [payloads[i] for i in np.flatnonzero(kinds == SPANS).tolist()]:
        ask.add(SPANS, *_spans(spans))
    if mine := [payloads[i] for i in np.flatnonzero(kinds == ANCHORS).tolist()]:
        f, c, d, r, p, *halves = entries(mine)
        order = np.lexsort((c, f))
        f, c, d, r, p, *halves = mine = [x[order] for x in (f, c, d, r, p, *halves)]
        grams = f[np.r_[True, f[1:] != f[:-1]]]
        held: list[list] = [[] for _ in mine]
        for payload in runs.column("payload").to_pylist():
            run = entries([payload])  # sorted, as the batch is: both are walked by search
            low, high = np.searchsorted(run[0], grams, "left"), np.searchsorted(run[0], grams, "right")
            hit = np.repeat(low, high - low) + np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            for column, values in zip(held, run, strict=True):
                column.append(values[hit])
        old = [np.concatenate(x) if x else np.empty(0, y.dtype) for x, y in zip(held, mine, strict=True)]
        both = [np.concatenate(x) for x in zip(mine, old, strict=True)]
        several = shared(both[0])
        if len(several):
            ask.ask(*(x[several] for x in both), several < len(f))
        known = np.zeros(len(f), bool)
        if len(old[0]):
            pair = np.unique(np.stack([old[0], old[1]]), axis=1)
            key = {*zip(pair[0].tolist(), pair[1].tolist(), strict=True)}
            near = np.flatnonzero(np.isin(f, pair[0]))
            known[near] = [x in key for x in zip(f[near].tolist(), c[near].tolist(), strict=True)]
        if not known.all():
            out[0].append(int(batch.column("part")[0].as_py()))
            out[1].append(HISTORY)
            out[2].append(_payload(*(x[~known] for x in mine)))
    found = [*_rows(out), *ask.flush()]
    return pa.Table.from_batches(found) if found else pa.table({"part": pa.array([], pa.int32()), "kind": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run per bucket; of equal entries the first document stays."""
    for t in whole_groups(batches, 1):
        part, payloads = t.column(0).to_numpy(), t.column(2).to_pylist()
        for b in np.unique(part).tolist():
            whole = _payload(*entries([payloads[i] for i in np.flatnonzero(part == b).tolist()]))
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([0], pa.int32()), pa.array([whole], pa.binary())], names=["part", "run", "payload"])


class FingerprintIndex:
    """An index in a folder; ``add`` merge-joins a batch with its runs and appends a run."""

    def __init__(self, spark: SparkSession, path: str, anchor_buckets: int, doc_buckets: int, files: int, version: int, runs: int, most_runs: int = MOST_RUNS) -> None:
        self.spark, self.path, self.most_runs = spark, path, most_runs
        self.anchor_buckets, self.doc_buckets, self.files = anchor_buckets, doc_buckets, files
        self.version, self.runs = version, runs
        self._open()

    @classmethod
    def create(cls, spark: SparkSession, path: str, docs: DataFrame, most_runs: int = MOST_RUNS) -> FingerprintIndex:
        """A new index, with buckets for batches of about the size of ``docs``."""
        index = cls(spark, path, *buckets(docs), parts(spark), 0, 0, most_runs)
        index._note()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str, most_runs: int = MOST_RUNS) -> FingerprintIndex:
        """The index as the last ``add`` or ``compact`` left it."""
        state = spark.read.json(f"{path}/manifest").orderBy(F.desc("version"), F.desc("runs")).first()
        return cls(spark, path, state["anchor_buckets"], state["doc_buckets"], state["files"], state["version"], state["runs"], most_runs)

    def _open(self) -> None:
        self.table = f"gleaner_runs_{uuid.uuid4().hex}"
        self.spark.sql(
            f"create table {self.table} ({_RUN}) using parquet clustered by (part) into {self.files} buckets location '{self.path}/v{self.version}'"
        )

    def _note(self) -> None:
        """Append the state to the manifest; files beyond the runs it names are of no account."""
        state = [(self.version, self.runs, self.anchor_buckets, self.doc_buckets, self.files)]
        self.spark.createDataFrame(state, "version int, runs int, anchor_buckets int, doc_buckets int, files int").coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def stored_runs(self) -> DataFrame:
        """The runs as rows of buckets: part, run, payload; read without a shuffle."""
        return self.spark.table(self.table).where(F.col("run") < self.runs)

    def _append(self, run: DataFrame) -> None:
        run.select("part", "run", "payload").repartition(self.files, "part").write.mode("append").insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)

    def add(self, batch: DataFrame) -> DataFrame:
        """The spans and requests of ``batch`` (doc_id, text) against itself and all runs."""
        small_batches(self.spark)
        dealt = anchors(batch, "words", GRAM, (self.anchor_buckets, self.doc_buckets)).repartition(self.files, "part")
        doc_buckets = self.doc_buckets
        joined = dealt.groupBy("part").cogroup(self.stored_runs().groupBy("part")).applyInArrow(lambda a, b: _merge_join(a, b, doc_buckets), PACKED)
        found = stored(joined, "substring-run")
        self._append(found.where(F.col("kind") == HISTORY).select("part", F.lit(self.runs).alias("run"), "payload"))
        self.runs += 1
        if self.runs > self.most_runs:
            self.compact()
        else:
            self._note()
        return found.where(F.col("kind") != HISTORY)

    def compact(self) -> None:
        """Merge all runs into one, as a new version."""
        small_batches(self.spark)
        merged_runs = self.stored_runs().repartition(self.files, "part").sortWithinPartitions("part").mapInArrow(_compact, _RUN)
        self.version += 1
        self._open()
        self._append(merged_runs)
        self.runs = 1
        self._note()


def _edges(rows: DataFrame, batches: int) -> list[int]:
    """doc_ids that cut ``rows`` into about equal batches."""
    found = rows.select(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    return sorted(set(found or []))


def _run(docs: DataFrame, batches: int, row, schema: pa.Schema, ddl: str, carried: bool = False) -> DataFrame:
    rows = texts(docs, *["carried"] * carried)
    edges = [None, *_edges(rows, batches), None]
    index = FingerprintIndex.create(docs.sparkSession, new_path(docs.sparkSession, "substring-index"), rows)
    resolved = None
    for low, high in zip(edges, edges[1:], strict=False):
        batch = rows
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        found = index.add(batch)
        resolved = found if resolved is None else resolved.union(found)
    return cut(rows, resolved, "words", GRAM, (index.anchor_buckets, index.doc_buckets), row, schema, ddl)


def add_documents(index: FingerprintIndex, batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of a later batch; ``corpus`` holds the texts of all that the index has seen."""
    rows = texts(batch)
    resolved = index.add(rows)
    return cut(rows, resolved, "words", GRAM, (index.anchor_buckets, index.doc_buckets), text_row, _TEXT, _TEXT_DDL, texts(corpus).union(rows))


def digest_row(doc_id: int, data: bytes, spans) -> tuple:
    words = data.split()
    n = len(words)
    if spans is not None:
        edges = [0, *(x for s in merged(*spans, n) for x in s), n]
        words = [w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]]
    return doc_id, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()


def text_row(doc_id: int, data: bytes, spans) -> tuple:
    """The text without the removed words and the white space before each; untouched texts are unchanged."""
    if spans is None:
        return doc_id, len(data.split()), 0, data.decode()
    places = [m.span() for m in _WORD.finditer(data)]
    n = len(places)
    gone = merged(*spans, n)
    kept, at = [], 0
    for first, end in gone:
        kept.append(data[at : places[first - 1][1] if first else 0])
        at = places[end - 1][1]
    kept.append(data[at:])
    return doc_id, n, sum(b - a for a, b in gone), b"".join(kept).decode()


_TEXT_DDL = "doc_id long, n_words long, n_removed long, kept_text string"


def remove_repeats(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed and the text that stays; and ``carried``, if ``docs`` has such a struct."""
    return _run(docs, batches, text_row, _TEXT, _TEXT_DDL, "carried" in docs.columns)


def repeats_digest(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    return _run(docs, batches, digest_row, _DIGEST, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
ORACLE: dict[str, str] = {}
