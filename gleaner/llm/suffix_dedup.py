"""Suffix-array dedup: remove later copies of byte strings, keep the first.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a
smaller doc_id.  Anchors say which contexts may repeat (see ``passages``); the suffixes of
these contexts are put into order, core by core, and the longest-previous-factor array, from
the previous and next smaller documents in that order, tells which strings have an earlier
match (see ``suffixes``).  Equal contexts are merged before they are ordered: all but those
of the smallest document are repeated as a whole.

Defined results: a null text counts as empty; texts are UTF-8 bytes, matches never cross
documents, and a removal may cut through a character (the kept bytes are then no longer
UTF-8, which ``kept_text`` repairs by dropping the broken bytes); rows without doc_id are
left out; rows that share a doc_id do not count as earlier to each other and keep bytes of
their own, by a hash of their text; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import stored, texts
from .passages import anchors, buckets, cut, merged, resolve

GRAM = 20

_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_KEPT = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept_text", pa.string())])


def _kept(data: bytes, spans: tuple[np.ndarray, np.ndarray] | None) -> tuple[list[tuple[int, int]], bytes]:
    if spans is None:
        return [], data
    whole = merged(*spans, len(data))
    edges = [0, *(x for s in whole for x in s), len(data)]
    return whole, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def digest_row(doc_id: int, data: bytes, spans) -> tuple:
    whole, kept = _kept(data, spans)
    return doc_id, len(data), len(data) - len(kept), len(whole), hashlib.sha256(kept).hexdigest()


def text_row(doc_id: int, data: bytes, spans) -> tuple:
    whole, kept = _kept(data, spans)
    return doc_id, [list(s) for s in whole], kept.decode(errors="ignore")


def _run(docs: DataFrame, row, schema: pa.Schema, ddl: str) -> DataFrame:
    rows = texts(docs)
    dealt = buckets(rows)
    resolved = stored(resolve(anchors(rows, "bytes", GRAM, dealt), dealt[1]), "suffix-resolved")
    return cut(rows, resolved, "bytes", GRAM, dealt, row, schema, ddl)


def remove_copies(docs: DataFrame) -> DataFrame:
    """doc_id, the removed byte spans, and the text that stays."""
    return _run(docs, text_row, _KEPT, "doc_id long, spans array<array<long>>, kept_text string")


def copies_digest(docs: DataFrame) -> DataFrame:
    return _run(docs, digest_row, _DIGEST, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return copies_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE: dict[str, str] = {}
