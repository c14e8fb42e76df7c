"""SimHash near-duplicates by a self-join of one binary trie.

Distinct fingerprints are the leaves of a binary trie; a node is all that share the bits from
the top down to its level.  The join walks pairs of nodes together, from both ends at once:
it adds up the bits in which a pair differs, and drops the pair once they exceed the budget.

The walk begins at the nodes of a depth that follows the number of fingerprints; nodes that hold
more than their share are split further, by their counts.  Each pair of nodes within the budget
is a cell, and its two nodes go there, so every pair of fingerprints can meet in exactly one
cell.  Below, the sorted fingerprints of a cell are an implicit trie: a node is a range of them.
Pairs of nodes are taken in pieces, depth first, and the pairs of fingerprints they end in are
merged into groups piece by piece, so memory is bounded by the cell, not by its pairs; two nodes
that are in one group already are not walked.  Bits are taken in the order of how evenly they
split the fingerprints, so that nodes of a depth are about equal.  For n fingerprints the walk
meets about n times the number of ways to choose the budget's bits among log2(n), however the
work is dealt.

Equal fingerprints are one node from the start, so copies never meet each other.

Defined results: a text without words (null, empty, white space) has fingerprint zero and
is linked like any other; a text of fewer words than a shingle is one shingle; rows
without doc_id are left out; an empty table gives an empty table; rows that repeat a
doc_id give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, one_row_each, small_batches, smallest_linked, stored, texts, whole_groups

SHINGLE = 4
BUDGET = 4
SEED = 42
#: The least depth at which nodes are dealt, and the fingerprints of a node from which it grows.
DEPTH, NODE = 4, 1 << 18
#: Pairs of nodes that are taken down a level at once, and linked pairs that wait to be merged.
PIECE, WAITING = 1 << 16, 1 << 18


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """64 bits; a bit is set if it is set in over half the shingle hashes."""
    w = text.encode().lower().split()  # bytes: lowers A-Z only, splits at ASCII white space only
    if not w:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(w) < words:
        return hashed(b" ".join(w), SEED)
    h = np.array([hashed(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, ``fp`` (the fingerprint as a signed long) and ``row``, a hash of the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], names=["doc_id", "fp", "row"])

    return texts(docs).withColumn("row", F.xxhash64("text")).mapInArrow(run, "doc_id long, fp long, row long")


def in_order(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints with their bits rearranged: bit ``order[0]`` comes to the top."""
    out = np.zeros(len(fps), np.uint64)
    for bit in order:
        out = out << np.uint64(1) | fps >> np.uint64(bit) & np.uint64(1)
    return out


class Groups:
    """The groups of n positions that linked pairs make, merged as the pairs come."""

    def __init__(self, n: int) -> None:
        self.first = np.arange(n)
        self.runs = np.arange(n)  # rises where the group of neighbours differs
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        new = self.first[i] != self.first[j]
        if new.any():
            self.waiting.append((self.first[i[new]], self.first[j[new]]))
            self.n_waiting += int(new.sum())
            if self.n_waiting >= WAITING:
                self.settle()

    def settle(self) -> np.ndarray:
        """The smallest position of the group of each."""
        if self.waiting:
            a, b = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
            self.first = smallest_linked(len(self.first), a, b)[self.first]
            self.runs = np.cumsum(np.r_[False, self.first[1:] != self.first[:-1]])
            self.waiting, self.n_waiting = [], 0
        return self.first

    def apart(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Which pairs of ranges are not in one group as a whole."""
        runs, first = self.runs, self.first
        return (runs[a0] != runs[a1 - 1]) | (runs[b0] != runs[b1 - 1]) | (first[a0] != first[b0])


class Pairs:
    """All linked pairs, as they come."""

    def __init__(self) -> None:
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.found.append((i, j))

    def apart(self, a0: np.ndarray, *_: np.ndarray) -> np.ndarray:
        return np.ones(len(a0), bool)


def trie_pairs(fps: np.ndarray, pairs: list[tuple[int, int, int, int, int]], level: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions (i, j) within ``budget`` bits, of sorted distinct ``fps``."""
    held = Pairs()
    walk(fps, pairs, level, budget, held)
    return tuple(np.concatenate(x) for x in zip(*held.found, strict=True)) if held.found else (np.empty(0, np.int64),) * 2


def walk(fps: np.ndarray, pairs: list[tuple[int, int, int, int, int]], level: int, budget: int, into: Groups | Pairs) -> None:
    """Give the pairs of positions within ``budget`` bits, of sorted distinct ``fps``, to ``into``.

    ``pairs``: nodes to begin with, as ranges (from, to, from, to) whose values agree above
    ``level`` in each range, and the bits in which the two differ there.  A node may be
    paired with itself.
    """
    stack = [(level, *(np.array(x, np.int64) for x in zip(*pairs, strict=True)))] if pairs else []
    ones: dict[int, np.ndarray] = {}
    while stack:
        level, a0, a1, b0, b1, d = stack.pop()
        if len(a0) > PIECE:
            stack += [(level, *(x[at : at + PIECE] for x in (a0, a1, b0, b1, d))) for at in range(0, len(a0), PIECE)]
            continue
        still = into.apart(a0, a1, b0, b1)
        a0, a1, b0, b1, d = (x[still] for x in (a0, a1, b0, b1, d))
        leaves = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[leaves], b0[leaves]
        near = (i != j) & (np.bitwise_count(fps[i] ^ fps[j]) <= budget)
        into.add(i[near], j[near])
        if level < 0:
            continue
        a0, a1, b0, b1, d = (x[~leaves] for x in (a0, a1, b0, b1, d))
        if not len(a0):
            continue
        if level not in ones:
            ones[level] = np.r_[0, np.cumsum(fps >> np.uint64(level) & np.uint64(1), dtype=np.int64)]
        n = ones[level]
        am, bm = a1 - (n[a1] - n[a0]), b1 - (n[b1] - n[b0])  # zeros stand before ones
        same, more = a0 == b0, d + 1
        parts = ((a0, am, b0, bm, d, None), (am, a1, bm, b1, d, None), (a0, am, bm, b1, more, None), (am, a1, b0, bm, more, ~same))
        kept = []
        for p0, p1, q0, q1, e, also in parts:
            ok = (p1 > p0) & (q1 > q0) & (e <= budget)
            if also is not None:
                ok &= also
            kept.append((p0[ok], p1[ok], q0[ok], q1[ok], e[ok]))
        stack.append((level - 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))


class Nodes:
    """Nodes of the trie that cover it, of depths of their own: their first values (bits in order) and depths."""

    def __init__(self, first: np.ndarray, depth: np.ndarray) -> None:
        by = np.argsort(first)
        self.first, self.depth = first[by], depth[by]

    def of(self, values: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, values, "right") - 1

    def differing(self, i: int) -> np.ndarray:
        """The bits in which each node differs from node ``i``, above the shallower of the two."""
        shared = (64 - np.minimum(self.depth, self.depth[i])).astype(np.uint64)
        both = self.first ^ self.first[i]
        whole = shared == 64  # a shift by all 64 bits has no meaning
        return np.where(whole, 0, np.bitwise_count(both >> np.where(whole, 0, shared).astype(np.uint64)))

    def partners(self, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node where its partners begin, and all partners (itself among them)."""
        near = [np.flatnonzero(self.differing(i) <= budget) for i in range(len(self.first))]
        return np.cumsum([0, *map(len, near)]), np.concatenate(near)


def _dealt(batches: Iterator[pa.RecordBatch], order: list[int], nodes: Nodes, budget: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint with the cells of its node: pairs of nodes, the smaller first."""
    start, partner = nodes.partners(budget)
    n = np.diff(start)
    for b in batches:
        fps = b.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), 1024):
            part = fps[at : at + 1024]
            node = nodes.of(in_order(part, order))
            times = n[node]
            other = partner[np.repeat(start[node] - np.cumsum(times) + times, times) + np.arange(times.sum())]
            own = np.repeat(node, times)
            cell = (np.minimum(own, other) << 32) + np.maximum(own, other)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.repeat(part, times).view(np.int64))], names=["cell", "fp"])


def _stars(batches: Iterator[pa.RecordBatch], order: list[int], nodes: Nodes, budget: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint that is linked inside its cell with the first one it can reach there."""
    for t in whole_groups(batches, 1):
        cells, raw = t.column(0).to_numpy(), t.column(1).to_numpy().view(np.uint64)
        fps = in_order(raw, order)
        by = np.lexsort((fps, cells))
        cells, raw, fps = cells[by], raw[by], fps[by]
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True):
            u, v = divmod(int(cells[start]), 1 << 32)
            here, values = fps[start:end], raw[start:end]
            if u == v:
                pair = (0, len(here), 0, len(here), 0)
            else:  # the smaller node stands before
                middle = int(np.searchsorted(here, nodes.first[v]))
                pair = (0, middle, middle, len(here), int(nodes.differing(u)[v]))
            groups = Groups(len(here))
            level = 63 - int(min(nodes.depth[u], nodes.depth[v]))
            walk(here, [pair] if pair[1] > pair[0] and pair[3] > pair[2] else [], level, budget, groups)
            first = groups.settle()
            linked = first != np.arange(len(here))
            yield pa.RecordBatch.from_arrays([pa.array(values[linked].view(np.int64)), pa.array(values[first[linked]].view(np.int64))], names=["a", "b"])


def _nodes(distinct: DataFrame, order: list[int], depth: int, most: int) -> Nodes:
    """Nodes of ``depth``; those of more than ``most`` fingerprints are split by four bits more, again and again."""
    firsts, depths = [], []
    split, now = None, depth
    bit = lambda i: F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))
    value = lambda d: sum((F.shiftleft(bit(b), d - 1 - i) for i, b in enumerate(order[:d])), F.lit(0).cast("long"))
    while True:
        rows = distinct if split is None else distinct.where(value(now - 4).isin(split))
        counts = rows.groupBy(value(now).alias("node")).agg(F.count(F.lit(1)).alias("n")).collect()  # those of full nodes only
        large = [r["node"] for r in counts if r["n"] > most and now + 4 <= 62]
        whole = range(1 << depth) if split is None else [(s << 4) + k for s in split for k in range(16)]
        kept = set(whole) - set(large)
        firsts += [x << (64 - now) for x in kept]
        depths += [now] * len(kept)
        if not large:
            return Nodes(np.array(firsts, np.uint64), np.array(depths, np.int64))
        split, now = large, now + 4


def near_links(distinct: DataFrame, budget: int = BUDGET, depth: int | None = None, most: int = 2 * NODE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``distinct.fp`` within ``budget`` bits."""
    small_batches(distinct.sparkSession, 8192)
    bit = lambda i: F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1))
    counts = distinct.agg(F.count(F.lit(1)).alias("n"), *(F.sum(bit(i)).alias(f"b{i}") for i in range(64))).first()
    n = counts["n"]
    order = sorted(range(64), key=lambda i: (abs(2 * (counts[f"b{i}"] or 0) - n), -i))
    if depth is None:
        depth = max(DEPTH, (max(0, n - 1) // NODE).bit_length())
    nodes = _nodes(distinct, order, depth, most)
    return (
        distinct.select("fp")
        .mapInArrow(lambda it: _dealt(it, order, nodes, budget), "cell long, fp long")
        .repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(lambda it: _stars(it, order, nodes, budget), "a long, b long")
        .where("a <> b")
        .distinct()
    )


def _classed(docs: DataFrame, words: int, budget: int) -> DataFrame:
    """doc_id, row, fp and component_id of each row."""
    spark = docs.sparkSession
    found = stored(fingerprints(docs, words), "simhash")
    distinct = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = stored(components(near_links(distinct, budget)), "simhash-roots")
    small_batches(spark)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", "row", "fp", "component_id")


def near_classes(docs: DataFrame, words: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id (its smallest doc_id)."""
    found = _classed(docs, words, budget)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, words: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that of the smallest doc_id, and of its texts the smallest hash.

    Of rows that repeat doc_id and text one stays.
    """
    least = _classed(docs, words, budget).groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("k"))
    return one_row_each(docs, least.select("k.*"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_simhash": op9_simhash}
ORACLE: dict[str, str] = {}
