"""Passages of ``LENGTH`` symbols that also start in a document with a smaller doc_id.

Shared by suffix-array dedup (symbols are bytes) and substring dedup (symbols are words).
Running hashes only say where to look; what is removed is decided on contents, or for whole
contexts that meet over the network on 128-bit digests of their contents.

1. ``_anchor`` picks anchors: in every run of ``LENGTH`` symbols the smallest hash of
   ``gram`` symbols (all of equals), so two equal runs have equal anchors at equal places.
   An anchor's context is all that any window choosing it can cover.  Contexts that one task
   reads twice within ``CHUNK_BYTES`` are compared there, and only the smallest document's anchors
   are sent, so a passage that a third of all documents share arrives once per chunk, not once
   per document.
2. ``_resolve`` takes all anchors of a hash bucket.  Contexts that seem equal ask to be
   verified.  A window reaches half way from its gram to one end of the context or the other,
   so contexts that share one agree in the gram with one of its halves; an anchor carries 16
   bits of both.  Where different contexts of different documents agree in one, the first
   holder of each asks for its text to be put into suffix order; chance repeats of a gram,
   whose share grows with the corpus, send nothing.  A gram of many such contexts is split:
   they are cut into shares of their windows, and each share goes to its own core, the
   symbols that all windows of the share have in common (in the end the window itself).
3. ``_contexts`` cuts the contexts, or their shares, out of the texts, or takes the digests;
   equal ones in one task are settled there, so only the smallest document's is sent.
4. ``_windows`` takes all digests, and all contexts of a core: equal ones are repeated as a
   whole, and the windows of different ones are put into suffix order.  A bucket's contexts are
   unpacked and ordered some cores at a time.  The longest previous factor, from the next smaller documents before and behind in that order, decides
   (``suffixes``).
5. ``_apply`` cuts the spans found out of each document.

A row is known by doc_id and a hash of its text, so rows that share a doc_id keep their own
spans.  Anchors, spans, requests and contexts travel as packed arrays, a row per bucket, so a
row stands for thousands of them; the number of buckets follows the input and the session's
shuffle partitions.  Documents are dealt by a hash of doc_id, with their texts compressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import parts, plan_bytes, small_batches, whole_groups
from .suffixes import repeated_windows

LENGTH = 50
#: Text bytes after which a task sends what it has gathered; of bytes, anchors take some twenty times that memory.
CHUNK_BYTES = 8 << 20
#: Buckets to a shuffle partition, at least and at most, and input bytes to a bucket between.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_BYTES = 1, 64, 2 << 20
#: Input bytes to a bucket of anchors; the more of a document's anchors share a bucket, the better they pack.
ANCHOR_BYTES = 8 << 20
#: Words whose hashes a task remembers.
REMEMBERED = 50_000
#: Contexts of one gram that go to one core; more are dealt over several.
SHARE = 128
#: Bytes of contexts, in whole cores, that are put into suffix order at once; an order takes some hundred times that memory.
ORDERED_BYTES = 1 << 19
#: Bytes of contexts, in whole cores, that are unpacked into Python's objects at once.
HELD_BYTES = 4 << 20
#: Spans and requests that a task gathers before it sends them on.
GATHERED = 250_000
#: Values of a payload from which it is worth compressing.
LEAST_COMPRESSED = 24

ANCHORS, SPANS, TEXTS, DIGESTS, HISTORY = 0, 1, 2, 3, 4
PACKED = "part int, kind int, payload binary"
_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])

_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    """What ``pmod(xxhash64(doc_id), n)`` is in Spark (XXH64 of one long with seed 42)."""
    p1, p2, p3, p4, p5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return (x << _U(r)) | (x >> _U(64 - r))

    with np.errstate(over="ignore"):
        h = (_U(42) + p5 + _U(8)) ^ (turn(ids.astype(np.int64).view(_U) * p2, 31) * p1)
        h = turn(h, 27) * p1 + p4
        h = (h ^ (h >> _U(33))) * p2
        h = (h ^ (h >> _U(29))) * p3
        h ^= h >> _U(32)
    return np.mod(h.view(np.int64), n).astype(np.int32)


def row_hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, 5)


class Powers:
    """Powers of an odd number and of its inverse mod 2^64, as long as the longest text so far."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 2 * n
            up, down = np.full(size, self.base, _U), np.full(size, self.inverse, _U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


class Hasher:
    """Hashes of any run of symbols in constant time, from running sums."""

    def __init__(self, symbols: np.ndarray, powers: Powers) -> None:
        n = len(symbols)
        up, self.down = powers.upto(n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(symbols * up[:n], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        return _mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _slide(pick: Callable, a: np.ndarray, width: int) -> np.ndarray:
    """``pick`` over every run of ``width`` values."""
    have = 1
    while 2 * have <= width:
        a = pick(a[:-have], a[have:])
        have *= 2
    return a if have == width else pick(a[: len(a) - (width - have)], a[width - have :])


def pick_anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest value of some run of ``width`` values."""
    least = _slide(np.minimum, grams, width)
    edge = np.zeros(width - 1, _U)
    return np.flatnonzero(_slide(np.maximum, np.concatenate([edge, least, edge]), width) == grams)


def halves(h: Hasher, p: np.ndarray, gram: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """16 bits (0: too near an end) of the gram at each of ``p`` with what stands before it, and with what stands behind.

    Of the ``LENGTH - gram`` other symbols of a window, ``before`` precede the gram or ``behind`` follow it.
    """
    before = (LENGTH - gram) // 2
    behind = LENGTH - gram + 1 - before

    def bits(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        short = np.maximum(_mix(h.runs(start.clip(0), end.clip(max=n))) >> _U(48), _U(1)).astype(np.uint16)
        return np.where((start >= 0) & (end <= n), short, np.uint16(0))

    return bits(p - before, p + gram), bits(p, p + gram + behind)


class Symbols:
    """Turns a text into hashed symbols; ``kind`` is ``bytes`` or ``words``."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self.table = np.random.default_rng(7).integers(0, 1 << 63, 256, _U) * _U(2) + _U(1)
        self.memory: dict[bytes, int] = {}

    def of(self, data: bytes) -> np.ndarray:
        if self.kind == "bytes":
            return self.table[np.frombuffer(data, np.uint8)]
        words, memory = data.split(), self.memory  # bytes: splits at ASCII white space only
        if len(memory) > REMEMBERED:
            memory.clear()
        for w in set(words).difference(memory):
            memory[w] = xxhash.xxh64_intdigest(w, 11)
        return np.fromiter(map(memory.__getitem__, words), _U, len(words))


class Places:
    """Where runs of symbols stand in a text's bytes; words are taken as joined by one space."""

    def __init__(self, data: bytes, kind: str) -> None:
        if kind == "bytes":
            self.data, self.starts, self.n = data, None, len(data)
        else:
            words = data.split()
            self.data, self.n = b" ".join(words), len(words)
            self.starts = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, self.n) + 1)]

    def pieces(self, start: np.ndarray, end: np.ndarray) -> list[bytes]:
        data = self.data
        if self.starts is not None:
            start, end = self.starts[start], self.starts[end] - 1
        return [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


# Packed payloads ------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length; the first two as they are (hashes), the others compressed if they are long."""
    n = len(arrays[0])
    rest = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays[2:])
    if n >= LEAST_COMPRESSED:
        rest = zstandard.ZstdCompressor(level=1).compress(rest)
    return np.array([n], np.uint32).tobytes() + arrays[0].tobytes() + arrays[1].tobytes() + rest


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    out = [np.frombuffer(data, kinds[0], n, 4)]
    out.append(np.frombuffer(data, kinds[1], n, 4 + out[0].nbytes))
    rest, at = data[4 + out[0].nbytes + out[1].nbytes :], 0
    if n >= LEAST_COMPRESSED:
        rest = zstandard.ZstdDecompressor().decompress(rest)
    for kind in kinds[2:]:
        out.append(np.frombuffer(rest, kind, n, at))
        at += out[-1].nbytes
    return out


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


Rows = tuple[list, list, list]


def _send(part: np.ndarray, kind: int, pack: Callable[[np.ndarray], bytes], out: Rows) -> None:
    """A row per bucket that has something; ``pack`` gets the positions of its values."""
    small = part.astype(np.int16) if len(part) and part.max() < 1 << 15 else part  # sorted by radix
    order = np.argsort(small, kind="stable")
    sorted_part = part[order]
    starts = np.flatnonzero(np.r_[True, sorted_part[1:] != sorted_part[:-1]]) if len(part) else np.empty(0, np.int64)
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=False):
        out[0].append(int(sorted_part[start]))
        out[1].append(kind)
        out[2].append(pack(order[start:end]))


def _rows(out: Rows) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(out[0]), 1024):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 1024], t) for x, t in zip(out, _PACKED.types, strict=True)], schema=_PACKED)


def _send_spans(docs: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int, out: Rows, kind: int = SPANS) -> None:
    """Spans, or requests (anchor and share level), to the buckets of their documents."""
    order = np.lexsort((start, row, docs))
    docs, row, start, end = docs[order], row[order], start[order].astype(np.int32), end[order].astype(np.int32)
    _send(doc_bucket(docs, buckets), kind, lambda at: _pack(start[at], end[at], _steps(docs[at]), row[at]), out)


def _spans(payloads: list[bytes]) -> list[np.ndarray]:
    """doc_id, row, start and end (as longs) of packed spans, in the order of (doc_id, row)."""
    found = [_unpack(x, "i4", "i4", "i8", "u8") for x in payloads]
    if not found:
        return [np.empty(0, np.int64), np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)]
    d = np.concatenate([np.cumsum(x[2]) for x in found])
    r, a, b = (np.concatenate([x[i] for x in found]) for i in (3, 0, 1))
    order = np.lexsort((r, d))
    return [d[order], r[order], a[order].astype(np.int64), b[order].astype(np.int64)]


def _of_row(d: np.ndarray, r: np.ndarray, doc_id: int, row: int) -> slice:
    """The places of a row in arrays in the order of (doc_id, row)."""
    low, high = np.searchsorted(d, doc_id, "left"), np.searchsorted(d, doc_id, "right")
    inside = r[low:high]
    return slice(low + int(np.searchsorted(inside, _U(row), "left")), low + int(np.searchsorted(inside, _U(row), "right")))


# Step 1 ---------------------------------------------------------------------------------


def _anchor(batches: Iterator[pa.RecordBatch], kind: str, gram: int, anchor_buckets: int, doc_buckets: int) -> Iterator[pa.RecordBatch]:
    width = LENGTH - gram + 1
    symbols, powers = Symbols(kind), Powers(0x9E3779B97F4A7C15)
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        f, c, p, left, right, ahead, behind = (np.concatenate([h[i] for h in held]) for i in range(3, 10))
        sizes = [len(h[3]) for h in held]
        d, r, text = (np.repeat(np.array(x, t), sizes) for x, t in (([h[0] for h in held], np.int64), ([h[1] for h in held], _U), (range(len(held)), np.int64)))
        out: Rows = ([], [], [])
        settled = np.zeros(len(f), bool)
        order = shared(f ^ _mix(c))
        order = order[np.lexsort((d[order], c[order], f[order]))]
        fo, co, do = f[order], c[order], d[order]
        begins = np.r_[True, (fo[1:] != fo[:-1]) | (co[1:] != co[:-1])] if len(order) else np.empty(0, bool)
        first = np.flatnonzero(begins)[np.cumsum(begins) - 1]
        later = np.flatnonzero(do > do[first])
        if len(later):  # equal by hash: compare
            both = np.stack([order[later], order[first[later]]])
            begin, end = p - left, p + right
            places: dict[int, Places] = {}
            one, other = np.empty(len(later), object), np.empty(len(later), object)
            for ids, found in zip(both, (one, other), strict=True):
                by_text = np.argsort(text[ids], kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(text[ids][by_text]) != 0])
                for some in np.split(by_text, cuts[1:]):
                    t = int(text[ids[some[0]]])
                    if t not in places:
                        places[t] = Places(held[t][2], kind)
                    found[some] = places[t].pieces(begin[ids[some]], end[ids[some]])
            settled[order[later]] = one == other
        at = np.flatnonzero(settled)
        if len(at):
            _send_spans(d[at], r[at], p[at] - left[at], p[at] + right[at], doc_buckets, out)
            # Spans travel on with the anchors, dealt over all buckets.
            out[0][:] = [(b * 7919) % anchor_buckets for b in out[0]]
        at = np.flatnonzero(~settled)
        f, c, d, r, p, ahead, behind = f[at], c[at], d[at], r[at], p[at].astype(np.uint32), ahead[at], behind[at]
        bucket = ((f >> _U(32)) % _U(anchor_buckets)).astype(np.int32)
        f = f.astype(np.uint32)  # the rest of the hash is in the bucket
        _send(bucket, ANCHORS, lambda at: _pack(f[at], c[at], _steps(d[at]), r[at], p[at], ahead[at], behind[at]), out)
        yield from _rows(out)

    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            data = text.encode()
            if len(data) < LENGTH:
                continue
            s = symbols.of(data)
            n = len(s)
            if n < LENGTH:
                continue
            h = Hasher(s, powers)
            g = h.grams(gram)
            p = pick_anchors(g, width)
            start, end = np.maximum(p - (width - 1), 0), np.minimum(p + LENGTH, n)
            left, right = p - start, end - p
            c = _mix(h.runs(start, end) + left.astype(_U) * _U(0x9FB21C651E98DF25) + right.astype(_U) * _U(0xA24BAED4963EE407))
            held.append((doc_id, row_hash(data), data, g[p], c, p, left, right, *halves(h, p, gram, n)))
            size += len(data)
        if size >= CHUNK_BYTES:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


# Step 2 ---------------------------------------------------------------------------------


def entries(payloads: list[bytes]) -> list[np.ndarray]:
    """Gram hash, context hash, doc_id, row, place and the bits of both halves of packed anchors."""
    found = [_unpack(x, "u4", "u8", "i8", "u8", "u4", "u2", "u2") for x in payloads]
    columns = [np.concatenate([x[i] for x in found]) for i in range(7)]
    columns[2] = np.concatenate([np.cumsum(x[2]) for x in found])
    return columns


def _meeting(gram: np.ndarray, half: np.ndarray, least: np.ndarray, most: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which contexts agree in the gram and this half with another one, of different documents and with something new among them."""
    key = gram.astype(np.int64) << 16 | half
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    sizes = np.diff(np.r_[starts, len(key)])
    met = (sizes > 1) & (np.minimum.reduceat(least[order], starts) < np.maximum.reduceat(most[order], starts)) & np.logical_or.reduceat(new[order], starts)
    found = np.empty(len(key), bool)
    found[order] = np.repeat(met, sizes)
    return found & (half > 0)


class Requests:
    """Requests and spans of a task, sent on once there are many."""

    def __init__(self, doc_buckets: int) -> None:
        self.doc_buckets, self.count = doc_buckets, 0
        self.waiting: dict[int, list] = {SPANS: [], TEXTS: [], DIGESTS: []}

    def add(self, kind: int, *columns: np.ndarray) -> None:
        self.waiting[kind].append(columns)
        self.count += len(columns[0])

    def ask(self, f: np.ndarray, c: np.ndarray, d: np.ndarray, r: np.ndarray, p: np.ndarray, ahead: np.ndarray, behind: np.ndarray, new: np.ndarray | None = None) -> None:
        """What the holders of grams have to send; only groups with something ``new`` matter, if that is given."""
        order = np.lexsort((c, f))
        f, c, d, r, p = f[order], c[order], d[order], r[order], p[order].astype(np.int64)
        begins = np.r_[True, f[1:] != f[:-1]]
        context = begins | np.r_[True, c[1:] != c[:-1]]
        firsts, inside = np.flatnonzero(context), np.cumsum(context) - 1
        least, most = np.minimum.reduceat(d, firsts), np.maximum.reduceat(d, firsts)
        fresh = np.ones(len(firsts), bool) if new is None else np.logical_or.reduceat(new[order], firsts)
        verify = ((least < most) & fresh)[inside]
        self.add(DIGESTS, d[verify], r[verify], p[verify], np.zeros(int(verify.sum()), np.int32))
        gram = (np.cumsum(begins) - 1)[firsts]
        mixed = _meeting(gram, ahead[order][firsts], least, most, fresh) | _meeting(gram, behind[order][firsts], least, most, fresh)
        texts = (d == least[inside]) & mixed[inside]
        contexts = np.bincount(gram, mixed)  # of a gram, those that are sent
        level = np.ceil(np.log2(np.maximum(contexts[gram[inside[texts]]] / SHARE, 1))).astype(np.int32)
        self.add(TEXTS, d[texts], r[texts], p[texts], level)

    def flush(self) -> Iterator[pa.RecordBatch]:
        out: Rows = ([], [], [])
        for kind, waiting in self.waiting.items():
            if waiting:
                _send_spans(*(np.concatenate(x) for x in zip(*waiting, strict=True)), self.doc_buckets, out, kind)
                waiting.clear()
        self.count = 0
        yield from _rows(out)


def shared(f: np.ndarray) -> np.ndarray:
    """Places of the values of ``f`` that occur more than once."""
    order = np.argsort(f, kind="stable")
    same = f[order][1:] == f[order][:-1]
    return order[np.r_[False, same] | np.r_[same, False]] if len(f) else order


def _resolve(batches: Iterator[pa.RecordBatch], doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """Spans and requests of the anchors of whole buckets."""
    out = Requests(doc_buckets)
    for t in whole_groups(batches, 1):
        bucket, kinds, payloads = t.column("part").to_numpy(), t.column("kind").to_numpy(), t.column("payload").to_pylist()
        for part in np.unique(bucket).tolist():
            here = np.flatnonzero(bucket == part)
            if spans := [payloads[i] for i in here[kinds[here] == SPANS].tolist()]:
                out.add(SPANS, *_spans(spans))
            if mine := [payloads[i] for i in here[kinds[here] == ANCHORS].tolist()]:
                columns = entries(mine)
                several = shared(columns[0])
                if len(several):
                    out.ask(*(x[several] for x in columns))
        if out.count > GATHERED:
            yield from out.flush()
    yield from out.flush()


# Step 3 ---------------------------------------------------------------------------------


#: A context or a share of it.
_CONTEXT_ARROW = pa.schema(
    [("core", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("end", pa.int32()), ("context", pa.large_binary())]
)
#: What a packed row of ``_contexts`` holds: digests, spans, or a table of contexts.
DIGESTED, REPEATED, WHOLE = 0, 1, 2
_SENT = "bucket int, part int, kind int, payload binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def fold(t: pa.Table) -> bytes:
    """A table as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(t)
    return sink.getvalue().to_pybytes()


def unfold(values: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in values])


def shares(width: int, level: int) -> list[tuple[int, int]]:
    """The offsets lo..hi of the windows in each share of a context."""
    n = min(width, 1 << level)
    edges = [width * i // n for i in range(n + 1)]
    return [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _context_table(found: list[tuple]) -> pa.Table:
    """Contexts as a table; ``found`` has doc_id, row, cores, starts, ends, sizes and the joined contexts of each cut."""
    counts = [len(x[2]) for x in found]
    core, at, end, sizes = (np.concatenate([np.empty(0, t), *(x[i] for x in found)]) for i, t in ((2, _U), (3, np.int32), (4, np.int32), (5, np.int32)))
    docs, row = np.repeat(np.array([x[0] for x in found], np.int64), counts), np.repeat(np.array([x[1] for x in found], _U), counts)
    offsets = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    contexts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(x[6] for x in found))])
    signed = [(x ^ _U(1 << 63)).view(np.int64) for x in (core, row)]
    return pa.Table.from_arrays([pa.array(x) for x in (signed[0], docs, signed[1], at, end)] + [contexts], schema=_CONTEXT_ARROW)


def _settled(t: pa.Table) -> np.ndarray:
    """Which contexts a smaller document has too, in the same core; only cores that occur twice are unpacked."""
    gone = np.zeros(t.num_rows, bool)
    core, docs = t.column("core").to_numpy(), t.column("doc_id").to_numpy()
    twice = shared(core)
    if len(twice):
        twice = twice[np.lexsort((docs[twice], core[twice]))]
        starts = np.flatnonzero(np.r_[True, core[twice][1:] != core[twice][:-1]])
        contexts = t.column("context").combine_chunks()
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(twice)], strict=True):
            first: dict[bytes, int] = {}
            for i in twice[start:end].tolist():  # in the order of doc_id
                gone[i] = first.setdefault(contexts[i].as_py(), docs[i]) < docs[i]
    return gone


def _contexts(docs: pa.Table, packed: pa.Table, kind: str, gram: int, anchor_buckets: int, doc_buckets: int) -> pa.Table:
    """Per request the digest of its context, or the text of it or of its shares with the hash of the core.

    Equal ones are settled here, as spans that are repeated.
    """
    width = LENGTH - gram + 1
    asked_kind, payloads = packed.column("kind").to_pylist(), packed.column("payload").to_pylist()
    d, r, p, levels = _spans([x for x, k in zip(payloads, asked_kind, strict=True) if k == TEXTS])
    vd, vr, vp, _ = _spans([x for x, k in zip(payloads, asked_kind, strict=True) if k == DIGESTS])
    found: list[tuple] = []
    digests: list[tuple] = []
    unpacked = zstandard.ZstdDecompressor().decompress
    digest, strong = xxhash.xxh64_intdigest, xxhash.xxh3_128_digest
    seen = set()
    known = np.unique(np.concatenate([d, vd]))
    ids, texts = docs.column("doc_id").to_numpy(), docs.column("text")
    for i in np.flatnonzero(np.isin(ids, known)).tolist():
        doc_id, data = int(ids[i]), unpacked(texts[i].as_py())
        row = row_hash(data)
        some, verify = _of_row(d, r, doc_id, row), _of_row(vd, vr, doc_id, row)
        if (some.start == some.stop and verify.start == verify.stop) or (doc_id, row) in seen:
            continue
        seen.add((doc_id, row))
        places = Places(data, kind)
        if verify.stop > verify.start:
            at = np.unique(vp[verify])
            start, end = np.maximum(at - (width - 1), 0), np.minimum(at + LENGTH, places.n)
            digests.append((doc_id, row, start, end, b"".join(map(strong, places.pieces(start, end)))))
        asked = np.unique(np.stack([levels[some], p[some]]), axis=1)
        for level in np.unique(asked[0]).tolist():
            at = asked[1][asked[0] == level]
            for share, (lo, hi) in enumerate(shares(width, level)):
                start, end = np.maximum(at - hi, 0), np.minimum(at - lo + LENGTH, places.n)
                ok = end - start >= LENGTH
                a, start, end = at[ok], start[ok], end[ok]
                cores = np.array([digest(x, level << 8 | share) for x in places.pieces(a - lo, a - hi + LENGTH)], _U)
                cut_out = places.pieces(start, end)
                sizes = np.fromiter(map(len, cut_out), np.int32, len(cut_out))
                found.append((doc_id, row, cores, start.astype(np.int32), end.astype(np.int32), sizes, b"".join(cut_out)))
    table = _context_table(found)
    found.clear()
    gone = _settled(table)
    spans = [tuple(table.column(i).to_numpy()[gone] for i in (1, 2, 3, 4))]
    spans = [(d, r.view(_U) ^ _U(1 << 63), a.astype(np.int64), b.astype(np.int64)) for d, r, a, b in spans]
    out: Rows = ([], [], [])
    stays = np.flatnonzero(~gone)
    if len(stays):
        mine = np.mod(table.column("core").to_numpy()[stays], anchor_buckets).astype(np.int32)
        _send(mine, WHOLE, lambda at: fold(table.take(pa.array(stays[at]))), out)
    if digests:
        sizes = [len(x[2]) for x in digests]
        vd, vr = np.repeat(np.array([x[0] for x in digests], np.int64), sizes), np.repeat(np.array([x[1] for x in digests], _U), sizes)
        start, end = np.concatenate([x[2] for x in digests]), np.concatenate([x[3] for x in digests])
        h = np.frombuffer(b"".join(x[4] for x in digests), _U).reshape(-1, 2)
        again = later_of_equals(h[:, 0], h[:, 1], vd)
        spans.append((vd[again], vr[again], start[again], end[again]))
        vd, vr, start, end, h = vd[~again], vr[~again], start[~again].astype(np.uint32), (end - start)[~again].astype(np.uint16), h[~again]
        _send((h[:, 0] % _U(anchor_buckets)).astype(np.int32), DIGESTED, lambda at: _pack(h[at, 0], h[at, 1], _steps(vd[at]), vr[at], start[at], end[at]), out)
    d, r, a, b = (np.concatenate(x) for x in zip(*spans, strict=True))
    if len(d):
        _send_spans(*_joined(d, r, a, b), doc_buckets, out, REPEATED)
    # Contexts and digests go by their bucket; spans, which are settled, anywhere.
    keys = [part if k != REPEATED else (part * 7919) % anchor_buckets for part, k in zip(out[0], out[1], strict=True)]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip((keys, *out), _SENT_ARROW.types, strict=True)], schema=_SENT_ARROW)


# Step 4 ---------------------------------------------------------------------------------


def later_of_equals(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which of the digests (h1, h2) a smaller document has too."""
    again = np.zeros(len(docs), bool)
    at = shared(h1)
    if len(at):
        at = at[np.lexsort((h2[at], h1[at]))]
        begins = np.r_[True, (h1[at][1:] != h1[at][:-1]) | (h2[at][1:] != h2[at][:-1])]
        least = np.minimum.reduceat(docs[at], np.flatnonzero(begins))
        again[at] = docs[at] > least[np.cumsum(begins) - 1]
    return again


def _joined(d: np.ndarray, r: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each row in order, with those that overlap or touch joined."""
    order = np.lexsort((a, r, d))
    d, r, a, b = d[order], r[order], a[order], b[order]
    begins = np.r_[True, (d[1:] != d[:-1]) | (r[1:] != r[:-1])]
    # The furthest end so far, row by row: rows are set apart by an offset that no end exceeds.
    apart = (np.cumsum(begins) - 1) * (int(b.max()) + 2)
    furthest = np.maximum.accumulate(b + apart)
    first = np.flatnonzero(begins | np.r_[True, (a + apart)[1:] > furthest[:-1]])
    return d[first], r[first], a[first], np.maximum.reduceat(b, first)


def _verified(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """Spans of the contexts whose digests a smaller document has too."""
    found = [_unpack(x, "u8", "u8", "i8", "u8", "u4", "u2") for x in payloads]
    h1, h2, r, a, n = (np.concatenate([x[i] for x in found]) for i in (0, 1, 3, 4, 5))
    d = np.concatenate([np.cumsum(x[2]) for x in found])
    again = later_of_equals(h1, h2, d)
    a = a[again].astype(np.int64)
    return d[again], r[again], a, a + n[again]


def _whole_cores(one: np.ndarray, core: np.ndarray, texts: list[bytes]) -> Iterator[np.ndarray]:
    """``one``, places of contexts in the order of their cores, in runs of whole cores that hold about ``ORDERED_BYTES``."""
    if not len(one):
        return
    begins = np.flatnonzero(np.r_[True, core[one][1:] != core[one][:-1]])
    before = np.cumsum(np.fromiter((len(texts[i]) for i in one.tolist()), np.int64, len(one)))[begins[1:] - 1]
    run = np.r_[0, before // ORDERED_BYTES]
    yield from np.split(one, begins[np.flatnonzero(np.diff(run)) + 1])


def _ordered(t: pa.Table, kind: str) -> list[tuple[np.ndarray, ...]]:
    """Spans of the contexts of whole cores that start in smaller documents too, as a whole or window by window."""
    core, docs, row, at, end = (t.column(i).to_numpy() for i in range(5))
    row = row.view(_U) ^ _U(1 << 63)
    texts = t.column("context").to_pylist()
    names: dict[bytes, int] = {}
    content = np.fromiter((names.setdefault(x, len(names)) for x in texts), np.int64, len(texts))
    # Of equal contexts those of larger documents are repeated as a whole.
    order = np.lexsort((docs, content, core))
    begins = np.r_[True, (core[order][1:] != core[order][:-1]) | (content[order][1:] != content[order][:-1])]
    same = np.empty(len(order), np.int64)
    same[order] = np.cumsum(begins) - 1
    firsts = order[begins]
    whole = docs > docs[firsts][same]
    found = [(docs[whole], row[whole], at[whole].astype(np.int64), end[whole].astype(np.int64))]
    # Different contexts of a core, each with its smallest document.
    starts = np.flatnonzero(np.r_[True, core[firsts][1:] != core[firsts][:-1]])
    differ = np.minimum.reduceat(docs[firsts], starts) < np.maximum.reduceat(docs[firsts], starts)
    one = firsts[np.repeat(differ, np.diff(np.r_[starts, len(firsts)]))]
    # Every row that is first with a context has its windows.
    holders = np.flatnonzero(~whole)
    holders = holders[np.argsort(same[holders], kind="stable")]
    for some in _whole_cores(one, core, texts):
        which, offset = repeated_windows([texts[i] for i in some.tolist()], docs[some], kind, LENGTH)
        if not len(which):
            continue
        mine = same[some[which]]
        low, high = np.searchsorted(same[holders], mine, "left"), np.searchsorted(same[holders], mine, "right")
        times = high - low
        inside = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        who = holders[np.repeat(low, times) + inside]
        start = at[who].astype(np.int64) + np.repeat(offset, times)
        found.append(_joined(docs[who], row[who], start, start + LENGTH))
    return found


def _core_runs(t: pa.Table) -> Iterator[pa.Table]:
    """``t``, contexts, dealt by a hash of the core into tables of about ``HELD_BYTES``."""
    n = -(-t.nbytes // HELD_BYTES)
    if n <= 1:
        yield t.combine_chunks()
        return
    run = _mix(t.column("core").to_numpy().view(_U)) % _U(n)
    for i in range(n):
        some = t.filter(pa.array(run == _U(i)))
        if some.num_rows:
            yield some.combine_chunks()


def _windows(batches: Iterator[pa.RecordBatch], kind: str, doc_buckets: int) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        out: Rows = ([], [], [])
        d, r, a, b = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else [np.empty(0, np.int64)] * 4
        if len(d):
            _send_spans(*_joined(d, r, a, b), doc_buckets, out)
        yield from _rows(out)

    for t in whole_groups(batches, 1):
        kinds, payloads = t.column("kind").to_numpy(), t.column("payload").to_pylist()
        of = lambda kind: [payloads[i] for i in np.flatnonzero(kinds == kind).tolist()]
        if repeated := of(REPEATED):
            yield from _rows(([p for p, k in zip(t.column("part").to_pylist(), kinds, strict=True) if k == REPEATED], [SPANS] * len(repeated), repeated))
        if digested := of(DIGESTED):
            waiting.append(_verified(digested))
            if len(waiting[-1][0]) > GATHERED:
                yield from flush()
                waiting = []
        if whole := of(WHOLE):
            for some in _core_runs(unfold(whole)):
                waiting += _ordered(some, kind)
                if sum(len(x[0]) for x in waiting) > GATHERED:
                    yield from flush()
                    waiting = []
    yield from flush()


# Step 5 ---------------------------------------------------------------------------------


def merged(start: np.ndarray, end: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Maximal spans inside 0..n."""
    order = np.argsort(start, kind="stable")
    start, end = start[order].clip(0, n), np.maximum.accumulate(end[order].clip(0, n))
    begins = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[begins].tolist(), end[np.r_[begins[1:], len(end)] - 1].tolist(), strict=True))


def _apply(docs: pa.Table, packed: pa.Table, row: Callable[[int, bytes, tuple | None], tuple], schema: pa.Schema) -> pa.Table:
    """``row(doc_id, text bytes, spans)`` for each document, and what else the document carries."""
    d, r, a, b = _spans(packed.column("payload").to_pylist())
    unpacked = zstandard.ZstdDecompressor().decompress
    rows = []
    for doc_id, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), strict=True):
        data = unpacked(text)
        low = int(np.searchsorted(d, doc_id, "left"))
        some = _of_row(d, r, doc_id, row_hash(data)) if low < len(d) and d[low] == doc_id else slice(0, 0)
        rows.append(row(doc_id, data, (a[some], b[some]) if some.stop > some.start else None))
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    table = pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)
    return table.append_column("carried", docs.column("carried")) if "carried" in docs.column_names else table


# The plan -------------------------------------------------------------------------------


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose first column, a text, is compressed UTF-8."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for b in batches:
        first = pa.array([pack(x.encode()) for x in b.column(0).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([first, *b.columns[1:]], names=b.schema.names)


def compressed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` compressed, so that less of it is shuffled."""
    rows = docs.select("text", *(c for c in docs.columns if c != "text"))
    small_batches(docs.sparkSession)
    return rows.mapInArrow(_compressed, StructType([StructField("text", BinaryType()), *rows.schema.fields[1:]]))


def buckets(docs: DataFrame) -> tuple[int, int]:
    """Anchor and document buckets for ``docs``, from the session's partitions and Spark's estimate of the size."""
    n = parts(docs.sparkSession)
    by_size = lambda per: max(LEAST_BUCKETS * n, min(plan_bytes(docs) // per, MOST_BUCKETS * n))  # noqa: E731  the estimate may be far too high
    return by_size(ANCHOR_BYTES), by_size(BUCKET_BYTES)


def anchors(docs: DataFrame, kind: str, gram: int, dealt: tuple[int, int]) -> DataFrame:
    """Packed anchors of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lambda it: _anchor(it, kind, gram, *dealt), PACKED)


def resolve(packed: DataFrame, doc_buckets: int) -> DataFrame:
    """Spans and requests of packed anchors, each bucket in one task."""
    small_batches(packed.sparkSession)
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(lambda it: _resolve(it, doc_buckets), PACKED)


def cut(docs: DataFrame, resolved: DataFrame, kind: str, gram: int, dealt_by: tuple[int, int], row: Callable, schema: pa.Schema, ddl: str, corpus: DataFrame | None = None) -> DataFrame:
    """Settle the requests of ``resolved`` on contents and apply all spans to ``docs``.

    ``docs`` has doc_id, text, and may have a struct ``carried``, which is handed on.  Texts that are asked
    for are those of ``corpus`` (doc_id, text), or of ``docs``; then both uses are dealt alike, so that Spark
    can shuffle them once.
    """
    small_batches(docs.sparkSession)
    anchor_buckets, doc_buckets = dealt_by
    part = F.pmod(F.xxhash64("doc_id"), F.lit(doc_buckets)).cast("int")
    dealt = compressed(docs).withColumn("part", part)
    asked = dealt if corpus is None else compressed(corpus.select("doc_id", "text")).withColumn("part", part)
    spans = resolved.where(F.col("kind") == SPANS).select("part", "payload")
    requests = resolved.where(F.col("kind").isin(TEXTS, DIGESTS))
    contexts = asked.groupBy("part").cogroup(requests.groupBy("part")).applyInArrow(lambda a, b: _contexts(a, b, kind, gram, anchor_buckets, doc_buckets), _SENT)
    more = contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _windows(it, kind, doc_buckets), PACKED)
    spans = spans.union(more.select("part", "payload"))
    result = StructType.fromDDL(ddl)
    if "carried" in docs.columns:
        result = result.add("carried", docs.schema["carried"].dataType)
    return dealt.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(lambda a, b: _apply(a, b, row, schema), result)
