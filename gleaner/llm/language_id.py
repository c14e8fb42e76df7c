"""Language identification with string kernels, Nystroem landmarks and kernel ridge regression.

The blended-spectrum presence kernel of two texts is the number of n-grams (n = 1..3)
that both hold, over the geometric mean of their own numbers.  ``LANDMARKS`` texts stand
for the kernel's feature space (Nystroem); one-versus-rest kernel ridge regression gives a
column of coefficients per language.  A batch of texts is scored by two matrix products:
presence x landmark presence, then kernel x coefficients.

Texts are lower-cased, with runs of white space as one blank.  Every character of Unicode is
itself: three of them are 63 bits, so an n-gram is one number and nothing is merged.

Training reads text and language of rows that ``trains`` names and is the only sample here:
at most ``PER_LANGUAGE`` rows of a language and about ``MOST_ROWS`` in all, drawn by a hash of
doc_id from the rows of at most ``LONGEST`` bytes, so what the driver holds is bounded.  Every
document is scored whole, however long it is.

Defined results: a null text, or one without a letter, is ``und`` with score 0; rows
without a language are never learned from; without any labelled row everything is
``und``; of languages with equal scores the first in order is predicted; rows without doc_id are left out; an empty table gives an empty table; rows that
repeat a doc_id are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts

#: The bounds on training rows of one language, of all, and on the bytes of one; landmarks over all.
PER_LANGUAGE, MOST_ROWS, LONGEST = 400, 3200, 32 << 10
LANDMARKS = 160
#: Rows of presence that are multiplied at once.
BLOCK = 256
RIDGE = 1e-3
UNKNOWN = "und"
#: Below this score the pipeline rejects a document.
LEAST_SCORE = 0.2

_LETTER = regex.compile(r"\p{L}")


def ngrams(text: str) -> np.ndarray:
    """The distinct n-grams (n = 1..3) of a text, as sorted numbers."""
    chars = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    two = chars[:-1] << 21 | chars[1:]
    three = two[:-1] << 21 | chars[2:]
    return np.unique(np.concatenate([chars, two, three]))


@dataclass
class LanguageModel:
    languages: list[str]
    grams: np.ndarray  # the n-grams that some landmark holds, sorted
    landmarks: np.ndarray  # presence (0 or 1) by landmark and n-gram
    sizes: np.ndarray  # the number of n-grams of each landmark
    weights: np.ndarray  # landmarks x languages

    def presence(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts, as their n-grams, x n-grams of landmarks; over the root of the number of n-grams."""
        rows = np.zeros((len(texts), len(self.grams)), np.float32)
        for row, own in zip(rows, texts, strict=True):
            at = np.searchsorted(self.grams, own)
            at[at == len(self.grams)] = 0
            row[at[self.grams[at] == own]] = max(1, len(own)) ** -0.5
        return rows

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Texts, as their n-grams, x landmarks, in double precision."""
        marks = self.landmarks.astype(np.float32)
        parts = [self.presence(texts[at : at + BLOCK]) @ marks.T for at in range(0, len(texts), BLOCK)]
        return np.concatenate(parts).astype(np.float64) / np.sqrt(np.maximum(1, self.sizes)) if parts else np.zeros((0, len(marks)))

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray]:
        letters = np.array([bool(_LETTER.search(t)) for t in batch], bool)
        if not self.languages or not len(batch):
            return [UNKNOWN] * len(batch), np.zeros(len(batch))
        scores = self.kernel([ngrams(t) for t in batch]) @ self.weights
        best = scores.argmax(axis=1)
        names = [self.languages[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, scores.max(axis=1).clip(0, 1), 0.0)


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> LanguageModel:
    """Learn from (language, text) rows: Nystroem features, then a ridge solution per language."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return LanguageModel([], np.empty(0, np.int64), np.zeros((0, 0), np.uint8), np.zeros(0), np.zeros((0, 0)))
    texts = [ngrams(text) for _, text in rows]
    by_language = [[i for i, (lang, _) in enumerate(rows) if lang == name] for name in languages]
    each = max(1, landmarks // len(languages))
    chosen = [i for members in by_language for i in members[:each]]
    grams = np.unique(np.concatenate([texts[i] for i in chosen]))
    marks = np.stack([np.isin(grams, texts[i], assume_unique=True) for i in chosen]).astype(np.uint8)
    model = LanguageModel(languages, grams, marks, np.array([len(texts[i]) for i in chosen]), np.zeros((len(chosen), len(languages))))
    values, vectors = np.linalg.eigh(model.kernel([texts[i] for i in chosen]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = model.kernel(texts) @ root
    targets = np.array([[float(lang == name) for name in languages] for lang, _ in rows])
    # Languages weigh alike, however many documents each has.
    share = np.array([1 / len(by_language[languages.index(lang)]) for lang, _ in rows])[:, None]
    solved = np.linalg.solve(features.T @ (features * share) + ridge * np.eye(features.shape[1]), features.T @ (targets * share))
    model.weights = root @ solved
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def training_rows(docs: DataFrame, trains: Column, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` (language, text) rows of each language, by a hash of doc_id."""
    labelled = docs.where(trains & F.col("lang").isNotNull() & (F.octet_length("text") <= LONGEST)).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    per_language = max(1, min(per_language, MOST_ROWS // len(counts)))
    span = 1 << 30
    # Twice what is needed, so that the draw falls short of the bound only where the rows do.
    rates = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(span, 2 * per_language * span // n + 1))))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(span))
    drawn = labelled.withColumn("draw", draw).where(F.col("draw") < rates[F.col("lang")]).collect()
    taken: dict[str, int] = {}
    rows = []
    for r in sorted(drawn, key=lambda r: (r["draw"], r["doc_id"], r["text"])):
        if taken.get(r["lang"], 0) < per_language:
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            rows.append((r["lang"], r["text"]))
    return rows


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = LEAST_SCORE) -> DataFrame:
    """The documents of a learned language with a score of at least ``least``, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.predict([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(training_rows(docs, ~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE: dict[str, str] = {}
