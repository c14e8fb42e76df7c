"""The registered queries and the pipeline on the smallest tables."""

import os
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm import language_id, line_dedup, packing, queries, simhash, substring_dedup
from tests.llm.test_operators import plain_fingerprint, reach

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    from tests.test_queries import compare

    compare(spark, queries.QUERIES[name], queries.ORACLE[name], TABLES)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, TABLES).cache()
        assert after.columns == columns, name
        assert 0 < after.count() <= before.count(), name
        assert after.select("doc_id").distinct().count() == after.count()
        before = after
    # What stays holds no near copies and no repeated passages of 50 words.
    assert simhash.near_classes(before).where("doc_id <> component_id").count() <= 1
    assert substring_dedup.repeats_digest(before).where("n_removed > 0").count() == 0


def plain_pipeline(spark):
    """The five stages one after the other in plain Python; the model is fitted as in the first stage."""
    table = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = language_id.fit(language_id.training_rows(table, ~language_id.held_out()))
    docs = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    names, scores = model.predict(list(docs.values()))
    docs = {i: t for (i, t), n, s in zip(docs.items(), names, scores, strict=True) if n != "und" and s >= language_id.LEAST_SCORE}

    run, seen, kept = line_dedup.RUN, set(), {}
    for i in sorted(docs):
        lines, gone = docs[i].split("\n"), set()
        for at in range(len(lines) - run + 1):
            key = tuple(lines[at : at + run])
            if key in seen:
                gone.update(range(at, at + run))
            seen.add(key)
        if len(gone) < len(lines):
            kept[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    docs = kept

    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    root = reach(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    docs = {i: t for i, t in docs.items() if root[i] == i}

    word, first = re.compile(r"[^\x20\x09-\x0D]+"), {}
    places = {i: list(word.finditer(t)) for i, t in docs.items()}
    for i in sorted(docs):
        w = tuple(m[0] for m in places[i])
        for at in range(len(w) - 49):
            first.setdefault(w[at : at + 50], i)
    kept = {}
    for i, text in docs.items():
        w, gone = tuple(m[0] for m in places[i]), set()
        for at in range(len(w) - 49):
            if first[w[at : at + 50]] < i:
                gone.update(range(at, at + 50))
        if w and len(gone) == len(w):
            continue
        out, at = [], 0
        for k, m in enumerate(places[i]):
            if k in gone:
                if k - 1 not in gone:
                    out.append(text[at : places[i][k - 1].end() if k else 0])
                at = m.end()
        kept[i] = "".join([*out, text[at:]])
    return kept


def test_pipeline_equals_the_plain_version(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {}
    for i, text in plain_pipeline(spark).items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, piece] = (at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    rows = corpus_pipeline.run(spark, TABLES).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    bins = []  # best-fit decreasing, one piece after the other
    for n in sorted((r["length"] for r in rows), reverse=True):
        room = [(b, k) for k, b in enumerate(bins) if b >= n]
        if room:
            bins[min(room)[1]] -= n
        else:
            bins.append(4096 - n)
    assert len({r["sequence_id"] for r in rows}) == len(bins)


def test_pipeline_run_packs_all_that_stays(spark):
    found = corpus_pipeline.run(spark, TABLES)
    assert found.where("offset + length > 4096").count() == 0
    assert found.select("doc_id", "piece").distinct().count() == found.count()


def test_stages_keep_rows_that_share_an_id_and_columns_of_any_name(spark):
    """Unique texts stay whole, k rows stay k, and the operators' own column names are no harm."""
    r = random.Random(3)
    text = lambda: "\n".join(" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(12)) for _ in range(8))
    a, b, c = text(), text(), text()
    rows = [(1, a, "en"), (2, a, "en"), (2, b, "en"), (2, b, "en"), (3, c, None)]
    names = ("n_lines", "n_words", "n_removed", "n_runs", "kept_text", "row", "doc", "part", "marks", "payload", "core")
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_chars", F.length("text"))
    table = table.select("*", *(F.lit(9).alias(n) for n in names))
    for stage in (corpus_pipeline.delete_lines, corpus_pipeline.delete_passages):
        found = stage(spark, table, TABLES)
        assert found.columns == table.columns
        rows = found.collect()
        assert sorted((x["doc_id"], x["text"]) for x in rows) == sorted([(1, a), (2, b), (2, b), (3, c)])
        assert all(x[n] == 9 for x in rows for n in names)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table.limit(0), TABLES).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_language_id_on_documents_that_were_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op3_language_id"](spark, folder).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()}
    assert len(found) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    letters = lambda t: any(c.isalpha() for c in t or "")
    assert all((r["lang_pred"] == "und") == (not letters(docs[r["doc_id"]]["text"])) for r in found)
    judged = [r for r in found if r["held_out"] and docs[r["doc_id"]]["lang"] and r["lang_pred"] != "und"]
    right = sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in judged)
    assert len(judged) > 200 and right >= 0.95 * len(judged)
