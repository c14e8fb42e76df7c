"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

1. Words are counted in each task, and added up by word.
2. The vocabulary is hashed into blocked Bloom filters, one shard for each length: a word sets
   five bits of one 64-bit block.  Shards are built in chunks by the tasks that hold their words.
3. Each word generates its edits: every deletion is looked up among the words that are one
   shorter, and every replacement by a larger letter among those of its length, so each near
   pair is generated once (an insertion is the deletion of the other word).  Hashes are sums
   over the letters, so an edit's hash is made from the word's without writing the edit.
4. Only what a filter lets through is written out and shuffled to an exact join with the
   vocabulary, which removes what the filters let through falsely.
5. Forms are followed to the last by doubling steps; a form is ten times as frequent as its
   word, so chains are no longer than the number of digits of the largest count.

The filters are broadcast in passes of at most ``PASS_BYTES``, whatever the vocabulary holds;
a pass probes only what its chunks can hold.

Defined results: null and empty texts have no words; letters outside the pattern end a word;
rows without doc_id are left out; rows that repeat a doc_id count each; an empty table gives an
empty table; other columns are ignored.  A text is taken in stretches that end between words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, texts, whole_groups

LEAST_LENGTH, LEAST_COUNT, DROPPED, FORM_TIMES = 7, 2, 31, 10
#: Bytes of filters in one broadcast, blocks (64 bits) in one chunk, and words to a block.
PASS_BYTES, CHUNK, TO_BLOCK = 32 << 20, 8192, 2
#: Bytes of a text, words in a task's memory, and edits, that are handled at once.
STRETCH, HELD, PROBED = 1 << 20, 200_000, 1 << 20
#: Words whose edits one task generates, about.
DEALT = 50_000

_LETTER = rb"[A-Za-z\xc0-\xff]"
_FOLD = bytes(range(256)).replace(bytes(range(65, 91)), bytes(range(97, 123)))
#: An odd factor of the hash, and its inverse modulo 2^64.
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _stretches(text: str) -> Iterator[bytes]:
    """``text`` with one byte to a character (others than the pattern's are no letters), in stretches."""
    held, at, end = text.encode("latin-1", "replace"), 0, re.compile(b"[^A-Za-z\xc0-\xff]")
    while at < len(held):
        found = end.search(held, at + STRETCH)
        to = found.start() if found else len(held)
        yield held[at:to].translate(_FOLD)
        at = to


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and ``n``, after the letters that the documents' hashes drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(_LETTER + b"{%d,}" % LEAST_LENGTH).findall
        held: Counter = Counter()

        def emitted() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            out = pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                begun = zlib.crc32(b"%d:" % doc_id)
                for stretch in _stretches(text):
                    for word, n in Counter(runs(stretch)).items():
                        h = zlib.crc32(word.decode("latin-1").encode(), begun)
                        if h % DROPPED == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < LEAST_LENGTH:
                                continue
                        held[word] += n
                    if len(held) >= HELD:
                        yield emitted()
        yield emitted()

    small_batches(docs.sparkSession)
    counted = texts(docs).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _by_length(words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, letters) of the words of each length; letters are a matrix of bytes."""
    latin = [w.encode("latin-1") for w in words.to_pylist()]
    lengths = np.array([len(w) for w in latin])
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        yield length, at, np.frombuffer(b"".join(latin[i] for i in at.tolist()), np.uint8).reshape(-1, length)


def _powers(length: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(length - 1, _FACTOR, np.uint64)], dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def _block(mixed: np.ndarray, blocks: int) -> np.ndarray:
    return ((mixed >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _bits(mixed: np.ndarray) -> np.ndarray:
    """Five bits of a block (some may be the same)."""
    out = np.zeros(len(mixed), np.uint64)
    for i in range(5):
        out |= np.uint64(1) << (mixed >> np.uint64(6 * i) & np.uint64(63))
    return out


def filter_chunks(words: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """The filters of all lengths in chunks: ``part`` (length and chunk) and ``bits``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for length, _, letters in _by_length(b.column(0)):
                mixed = _mixed(((letters.astype(np.uint64) + np.uint64(1)) * _powers(length)).sum(axis=1, dtype=np.uint64))
                at = _block(mixed, blocks[length])
                columns = [(np.int64(length) << 32) + at // CHUNK, at % CHUNK, _bits(mixed).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "at", "bits"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1):
            part, at, bits = t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy().view(np.uint64)
            starts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(starts, starts[1:], strict=False):
                chunk = np.zeros(CHUNK, np.uint64)
                np.bitwise_or.at(chunk, at[a:b], bits[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(part[a : a + 1]), pa.array([chunk.tobytes()], pa.binary())], names=["part", "bits"])

    rows = words.select("word").mapInArrow(hashed, "part long, at long, bits long")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(filled, "part long, bits binary")


def passes(blocks: dict[int, int], most: int) -> list[dict[int, tuple[int, int]]]:
    """Ranges of chunks by length, dealt to passes of at most ``most`` chunks."""
    out: list[dict[int, tuple[int, int]]] = [{}]
    room = most
    for length, n in sorted(blocks.items()):
        first, chunks = 0, -(-n // CHUNK)
        while first < chunks:
            if not room:
                out.append({})
                room = most
            taken = min(room, chunks - first)
            out[-1][length] = (first, first + taken)
            first += taken
            room -= taken
    return out


class Prober:
    """Edits of words that the filters of one pass let through."""

    def __init__(self, filters: dict[int, tuple[int, np.ndarray]], blocks: dict[int, int], alphabet: bytes) -> None:
        self.filters, self.blocks, self.alphabet = filters, blocks, np.frombuffer(alphabet, np.uint8)

    def _through(self, h: np.ndarray, length: int) -> np.ndarray:
        first, bits = self.filters[length]
        mixed = _mixed(h)
        at = _block(mixed, self.blocks[length]) - first * CHUNK
        here = np.flatnonzero((at >= 0) & (at < len(bits)))
        if len(here) < len(h):
            mixed, at = mixed[here], at[here]
        mask = _bits(mixed)
        return here[(bits[at] & mask) == mask]

    def edits(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(word, place, letter) of replacements, and (word, place, None) of deletions, of words of one length."""
        words, length = letters.shape
        powers = _powers(length)
        values = letters.astype(np.uint64) + np.uint64(1)
        if length in self.filters:
            rising = np.sort(self.alphabet)
            for w, p, c in self._pieces(words, length, len(rising)):
                old, new = letters[w, p], rising[c]
                larger = np.flatnonzero(new > old)
                w, p, c = w[larger], p[larger], c[larger]
                whole = (values * powers).sum(axis=1, dtype=np.uint64)
                h = whole[w] + (rising[c].astype(np.uint64) - letters[w, p]) * powers[p]
                ok = self._through(h, length)
                yield w[ok], p[ok], rising[c[ok]]
        if length - 1 in self.filters:
            terms = values * powers
            before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
            whole = terms.sum(axis=1, dtype=np.uint64)
            for w, p, _ in self._pieces(words, length, 1):
                twice = np.flatnonzero((p + 1 == length) | (letters[w, p] != letters[w, np.minimum(p + 1, length - 1)]))  # of equal neighbours the last goes
                w, p = w[twice], p[twice]
                h = before[w, p] + (whole[w] - before[w, p] - terms[w, p]) * np.uint64(_INVERSE)
                ok = self._through(h, length - 1)
                yield w[ok], p[ok], None

    @staticmethod
    def _pieces(words: int, length: int, letters: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for at in range(0, words * length * letters, PROBED):
            i = np.arange(at, min(at + PROBED, words * length * letters))
            wp, c = np.divmod(i, letters)
            w, p = np.divmod(wp, length)
            yield w, p, c


def candidates(words: DataFrame, filters: dict[int, tuple[int, np.ndarray]], blocks: dict[int, int], alphabet: bytes) -> DataFrame:
    """(word, n, edit) where the broadcast filters of a pass hold the edit."""
    shared = words.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = Prober(shared.value, blocks, alphabet)
        for b in batches:
            for _, at, letters in _by_length(b.column(0)):
                for w, p, c in prober.edits(letters):
                    rows, places = w.tolist(), p.tolist()
                    texts = [letters[i].tobytes() for i in rows]
                    new = [b""] * len(rows) if c is None else [bytes((x,)) for x in c.tolist()]
                    edit = [(t[:k] + x + t[k + 1 :]).decode("latin-1") for t, k, x in zip(texts, places, new, strict=True)]
                    from_rows = pa.array(at[w])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(from_rows), b.column(1).take(from_rows), pa.array(edit, pa.string())], names=["word", "n", "edit"])

    lengths = sorted({k for held in filters for k in (held, held + 1)})
    return words.where(F.char_length("word").isin(lengths)).mapInArrow(run, "word string, n long, edit string")


def near_pairs(words: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Pairs (word, n, near, near_n) of the stored ``words`` that differ by one letter, each in both directions."""
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {length: -(-n // TO_BLOCK) for length, n in sizes.items()}
    used = words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()  # at most the pattern's letters
    alphabet = bytes(sorted(ord(r["c"]) for r in used if r["c"]))
    chunks = stored(filter_chunks(words, blocks), "spelling-filters")
    dealt, found = words.repartition(max(1, -(-sum(sizes.values()) // DEALT))), None  # a row is hundreds of probes
    for ranges in passes(blocks, max(1, pass_bytes // (8 * CHUNK))):
        filters: dict[int, tuple[int, np.ndarray]] = {}
        wanted = F.lit(False)
        for length, (a, b) in ranges.items():
            filters[length] = (a, np.zeros((b - a) * CHUNK, np.uint64))
            wanted |= F.col("part").between((length << 32) + a, (length << 32) + b - 1)
        for r in chunks.where(wanted).toLocalIterator():  # pass_bytes at most
            length, chunk = divmod(r["part"], 1 << 32)
            a, bits = filters[length]
            bits[(chunk - a) * CHUNK : (chunk - a + 1) * CHUNK] = np.frombuffer(r["bits"], np.uint64)
        here = candidates(dealt, filters, blocks, alphabet)
        found = here if found is None else found.union(here)
    exact = found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")).hint("merge"), "edit")
    one = F.struct("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
    other = F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return exact.select(F.inline(F.array(one, other)))


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """``forms`` (word, form) with the last form that can be reached."""
    reach, longest = 1, len(str(most))
    now = forms.select("word", F.col("form").alias("root"))
    while reach < longest:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = stored(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        reach *= 2
    return now


def variants(docs: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Every word with its form and root: word, form, root, n, n_near, form_n."""
    spark = docs.sparkSession
    words = stored(vocabulary(docs), "spelling-words")
    if not words.head(1):
        return spark.createDataFrame([], "word string, form string, root string, n long, n_near long, form_n long")
    small_batches(spark, 8192)
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    near = near_pairs(words, pass_bytes).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    is_form = -F.col("best.minus") >= FORM_TIMES * F.col("n")
    found = stored(
        words.join(near.hint("merge"), "word", "left").select(
            "word",
            F.when(is_form, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, -F.col("best.minus")).alias("form_n"),
        ),
        "spelling-forms",
    )
    forms = stored(found.where("form is not null").select("word", "form"), "spelling-links")
    roots = _roots(forms, found.agg(F.max("n")).first()[0])
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE: dict[str, str] = {}
