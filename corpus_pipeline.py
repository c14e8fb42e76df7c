"""From raw documents to packed sequences; part of the subpackage ``gleaner.llm``.

Each stage takes the documents that the one before kept and returns documents again, with
the columns of the table; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import language_id, line_dedup, packing, simhash, substring_dedup
from gleaner.llm.common import stored


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in one struct, so that no name can clash."""
    return docs.select("doc_id", "text", F.struct(F.col("doc_id"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text"))).alias("carried"))


def _with_text(docs: DataFrame, found: DataFrame, text: str, emptied) -> DataFrame:
    """``found`` with the columns of ``docs``; rows that a stage emptied are gone."""
    size = F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    made = {"text": F.col(text), "n_chars": size, "doc_id": F.col("doc_id")}
    return found.where(~emptied).select(*(made.get(c, F.col("carried")[c] if c not in made else None).alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no learned language, go."""
    model = language_id.fit(language_id.training_rows(docs, ~language_id.held_out()))
    return language_id.keep_identified(docs, model)


def delete_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go; so do documents that held nothing else."""
    found = line_dedup.delete_runs(_carried(docs))
    return _with_text(docs, found, "text", (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_lines")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest doc_id stays."""
    return simhash.drop_near(docs)


def delete_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words go; so do documents that held nothing else."""
    found = substring_dedup.remove_repeats(_carried(docs))
    return _with_text(docs, found, "kept_text", (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", delete_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", delete_passages),
    ("best-fit packing", pack),
]

#: Kernel scores, fingerprints and tokens are beyond SQL; a test compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
