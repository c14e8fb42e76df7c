"""Ranked lexical search by one automaton of all terms that is run over whole texts; no index of documents.

1. The items' distinct terms are numbered and put into an Aho-Corasick automaton, each between
   two guards (a blank stands for every run of characters that ends a term), so that only whole
   terms match.  The automaton is built by each worker from a broadcast list of terms.
2. A first scan of the texts counts documents, terms and the documents that hold each term, by
   task; the sums of all tasks give the weights.
3. A second scan counts the terms of each text again, maps them to the items that hold them,
   and adds up scores in 64-bit integers.  A task keeps the best documents of each item only.
4. The tasks' bests are ranked in two steps, by (item, share of the tasks) and by item.

What is broadcast is bounded: items are dealt into blocks of at most about ``BLOCK_BYTES`` of
terms and ``BLOCK_ITEMS`` items, and the texts are scanned for one block after the other.  A text is scanned
in stretches that end between terms, so a very long one takes no more memory than its stretch.

Defined results: a null or empty text has no term and is no document of the statistics; items
without a term, or whose terms no document holds, have no rows; equal scores rank by doc_id,
and rows that repeat a doc_id rank each; rows that repeat an item_id are one item with the
terms of all; rows without doc_id or item_id are left out, also of the statistics; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored, texts

TOP = 50
#: Bounds of one block of items: bytes of terms, and items.
BLOCK_BYTES, BLOCK_ITEMS = 1 << 20, 4096
#: Bytes of a text that are scanned at once, and (term, item) pairs that are added at once.
STRETCH, ADDED = 1 << 20, 1 << 20
#: Shares of the tasks whose bests are ranked first.
SHARES = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8: A-Z lowered, what ends a term is a blank, all else as it is.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


class TermCounter:
    """Counts the occurrences of given terms in a text."""

    def __init__(self, terms: list[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            self.automaton.add_word(f" {term} ", i)
        self.automaton.make_automaton()

    def counts(self, text: str) -> tuple[int, Counter]:
        """The number of terms of ``text``, and of each given term by its number."""
        folded = text.encode().translate(_FOLD)
        n, found, at = 0, Counter(), 0
        while at < len(folded):
            end = folded.find(b" ", at + STRETCH)
            end = len(folded) if end < 0 else end
            here = folded[at:end]
            n += len(here.split())
            found.update(map(itemgetter(1), self.automaton.iter(f" {here.decode()} ")))
            at = end
        return n, found


_counters: dict[str, TermCounter] = {}


def _counter(shared) -> TermCounter:
    """The automaton of a broadcast block; a worker keeps the last one from task to task."""
    key = shared.value["block"]
    if key not in _counters:
        _counters.clear()
        _counters[key] = TermCounter(shared.value["terms"])
    return _counters[key]


class Best:
    """The ``top`` best (score, then smallest doc_id) of each item so far."""

    def __init__(self, items: int, top: int) -> None:
        self.items, self.top = items, top
        self.least = np.zeros(items, np.int64)
        self.held = [np.empty(0, np.int64)] * 3
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` of ``docs`` (rows) for all items (columns)."""
        row, item = np.nonzero((scores > 0) & (scores >= self.least))
        if len(row):
            self.waiting.append((item, scores[row, item], docs[row]))
            self.n_waiting += len(row)
            if self.n_waiting > max(self.items * self.top, 1 << 16):
                self.settle()

    def settle(self) -> list[np.ndarray]:
        """(item, score, doc_id) of the best, after all that waits has been compared."""
        if self.waiting:
            item, score, doc = (np.concatenate([h, *w]) for h, w in zip(self.held, zip(*self.waiting, strict=True), strict=True))
            order = np.lexsort((doc, -score, item))
            item, score, doc = item[order], score[order], doc[order]
            first = np.searchsorted(item, np.arange(self.items))
            place = np.arange(len(item)) - first[item]
            kept = place < self.top
            last = place == self.top - 1
            self.least[item[last]] = score[last]
            self.held = [item[kept], score[kept], doc[kept]]
            self.waiting, self.n_waiting = [], 0
        return self.held


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms."""
    folded = F.translate("text", _UPPER, _LOWER)
    each = items.where("item_id is not null").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(_TERM), F.lit(0)))).alias("term"))
    return each.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def _statistics(docs: DataFrame, shared) -> tuple[int, int, dict[int, int]]:
    """N, L, and the documents of each term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared)
        held = np.zeros(len(shared.value["terms"]), np.int64)
        documents = total = 0
        for b in batches:
            for text in b.column(1).to_pylist():
                n, found = counter.counts(text)
                documents += n > 0
                total += n
                held[list(found)] += 1
        terms = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *terms.tolist()], pa.int64()), pa.array([total, documents, *held[terms].tolist()], pa.int64())], names=["term", "n"])

    rows = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most the terms of a block
    found = {r["term"]: r["n"] for r in rows}
    return found.pop(-1, 0), found.pop(-2, 0), found


def _bests(docs: DataFrame, shared, weights: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """Each task's best documents of each item of the block: item_id, doc_id, score, task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, block = _counter(shared), shared.value
        start, holders, ids = block["start"], block["holders"], block["items"]
        best = Best(len(ids), top)
        degree = np.diff(start)

        def add(doc_ids: list[int], terms: list[int], parts: list[int], rows: list[int]) -> None:
            t, row = np.array(terms, np.int64), np.array(rows, np.int64)
            n = degree[t]
            before = np.cumsum(n) - n
            item = holders[np.repeat(start[t] - before, n) + np.arange(n.sum())]
            scores = np.zeros((len(doc_ids), len(ids)), np.int64)
            np.add.at(scores, (np.repeat(row, n), item), np.repeat(weights[t] * np.array(parts, np.int64), n))
            best.add(np.array(doc_ids, np.int64), scores)

        for b in batches:
            held, size = ([], [], [], []), 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, found = counter.counts(text)
                if not found:
                    continue
                m = 20 * (50 + 50 * n * documents // total)
                held[1].extend(found)
                held[2].extend(1_000_000_000 * tf // (1000 * tf + m) for tf in found.values())
                held[3].extend([len(held[0])] * len(found))
                held[0].append(doc_id)
                size += int(degree[list(found)].sum())
                if size > ADDED:
                    add(*held)
                    held, size = ([], [], [], []), 0
            if held[0]:
                add(*held)
        item, score, doc = best.settle()
        task = pa.array(np.full(len(item), TaskContext.get().partitionId(), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(ids[item]), pa.array(doc), pa.array(score), task], names=["item_id", "doc_id", "score", "task"])

    return docs.mapInArrow(run, "item_id long, doc_id long, score long, task long")


def search(items: DataFrame, docs: DataFrame, top: int = TOP, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = stored(item_terms(items), "search-items")
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("aggregate(terms, 0L, (a, t) -> a + octet_length(t))")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    scanned, found = texts(docs), None
    for nr in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == nr).collect()  # about block_items at most
        terms = sorted({t for r in block for t in r["terms"]})
        if not terms:
            continue
        number = {t: i for i, t in enumerate(terms)}
        pairs = sorted((number[t], i) for i, r in enumerate(block) for t in r["terms"])
        start = np.searchsorted(np.array([t for t, _ in pairs]), np.arange(len(terms) + 1))
        value = {"block": uuid.uuid4().hex, "terms": terms, "start": start, "holders": np.array([i for _, i in pairs]), "items": np.array([r["item_id"] for r in block], np.int64)}
        shared = spark.sparkContext.broadcast(value)
        documents, total, held = _statistics(scanned, shared)
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
        here = _bests(scanned, shared, weights, documents, total, top)
        found = here if found is None else found.union(here)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    first = [F.desc("score"), F.asc("doc_id")]
    share = Window.partitionBy("item_id", F.pmod("task", F.lit(SHARES))).orderBy(*first)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*first)).cast("int")
    nearly = found.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= top)
    return nearly.withColumn("rank", rank).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLE = {
    "op12_lexical_search": rf"""
    WITH words AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM documents),
    sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
    tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
    dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
    wanted AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
    scores AS (
        SELECT item_id, doc_id,
               sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT
                   * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total))))::BIGINT AS score
        FROM wanted JOIN dfs USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), whole
        GROUP BY item_id, doc_id)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
    WHERE rank <= {TOP}"""
}
