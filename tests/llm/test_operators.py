"""Each operator against a plain version, on small tables that hold every awkward case."""

import base64
import hashlib
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import byte_bpe, embedding_dedup, exact_dedup, language_id, line_dedup, packing, passages, simhash, substring_dedup, suffix_dedup, suffixes, warc
from gleaner.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, part int, start string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "ré", "st", "on", "Ü", "ing"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def make_texts():
    shared, other = prose(1, 80), prose(2, 60)
    near = prose(3, 150)
    rows = [None, "", " ", "a", "a b", "\n\n\n\n\n", "x\ny\nz\nx\ny\nz\nx", "same text", "same text", "same text", "12345 67890 !!", "ß İ Σ ΑΣ é \U0001f600"]
    rows += [shared, prose(4, 30) + " " + shared + " " + prose(5, 30), shared + " " + other, prose(6, 20) + " " + other + " " + shared[200:], other]
    rows += [near, near.replace("the", "THE"), near + " end", near[:-30] + prose(7, 5)]
    rows += ["ab" * 4000, "one line of it\n" * 30, "\n".join(f"line {i}" for i in range(40)), "head\n" + "\n".join(f"line {i}" for i in range(5, 25)) + "\ntail"]
    rows += [prose(100 + i, 5 * i) for i in range(20)] + [prose(8, 6000), prose(8, 6000)]
    return list(enumerate(rows, 10))


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or ""), 1, 2, "x") for i, t in TEXTS]
    rows.append((None, "no id", "en", "s", 5, 1, 2, "x"))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df, key="doc_id"):
    rows = [r.asDict() for r in df.collect()]
    found = {r.pop(key): tuple(r.values()) for r in rows}
    assert len(found) == len(rows)
    return found


def reach(ids, pairs):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_line_dedup(docs, empty):
    run, seen, want = line_dedup.RUN, {}, {}
    for i, t in TEXTS:
        lines = (t or "").split("\n")
        gone = set()
        for at in range(len(lines) - run + 1):
            key = tuple(lines[at : at + run])
            if key in seen:
                gone.update(range(at, at + run))
            seen.setdefault(key, (i, at))
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        runs = sum(1 for k in gone if k - 1 not in gone)
        want[i] = (kept, len(lines), len(gone), runs)
    found = line_dedup.delete_runs(docs)
    assert found.columns[:1] == ["doc_id"] and "keep_id" in found.columns
    rows = {r["doc_id"]: (r["text"] or "", r["n_lines"], r["n_removed"], r["n_runs"]) for r in found.collect()}
    assert rows == want
    assert sum(w[2] for w in want.values()) > 20
    assert line_dedup.delete_runs(empty).count() == 0


def test_line_dedup_has_no_python(docs):
    plan = line_dedup.delete_runs(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("table_bytes", [1 << 20, 300])
def test_exact_dedup(docs, empty, table_bytes):
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(t or "", []).append(i)
    want = {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert collect(exact_dedup.exact_classes(docs, table_bytes)) == want
    assert exact_dedup.exact_classes(empty).count() == 0
    assert exact_dedup.drop_copies(docs).count() == len(groups)


def test_exact_dedup_repeated_rows(docs):
    rows = exact_dedup.exact_classes(docs.where("doc_id = 17").union(docs.where("doc_id = 17")).repartition(2)).collect()
    assert [(r["keep_id"], r["group_size"]) for r in rows] == [(17, 2)] * 2


def test_language_id(spark, docs, empty):
    letters = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "жзиклмно"}
    r = random.Random(3)
    made = [
        (i, " ".join("".join(r.choice(letters[lang]) for _ in range(5)) for _ in range(r.randint(3, 40))), lang)
        for i, lang in enumerate(sorted(letters) * 60)
    ]
    table = spark.createDataFrame([*made, (1000, None, "aa"), (1001, "12 34", "aa"), (1002, "", None)], "doc_id long, text string, lang string")
    model = language_id.fit(language_id.training_rows(table, ~language_id.held_out()))
    found = collect(language_id.identify(table, model))
    assert all(found[i][0] == lang and 0 < found[i][1] <= 1 for i, _, lang in made)
    assert [found[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert language_id.keep_identified(table, model).count() == len(made)
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(language_id.training_rows(empty, ~language_id.held_out()))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}


def spectrum(text):
    t = " ".join(text.lower().split())
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_is_the_presence_kernel():
    rows = [("aa", "abc abd"), ("bb", "xyz  ABC"), ("aa", "bcd bcd bcd"), ("zh", "漢字 \U0001f600"), ("ja", "日本の字")]
    model = language_id.fit(rows)
    chosen = ["abc abd", "bcd bcd bcd", "xyz abc", "日本の字", "漢字 \U0001f600"]  # by language
    for text in ("abc", "zzz abd", "q", "漢字", "日字"):
        a = spectrum(text)
        want = [len(a & spectrum(c)) / (len(a) * len(spectrum(c))) ** 0.5 for c in [chosen[0], chosen[1], chosen[2], chosen[3], chosen[4]]]
        assert np.allclose(model.kernel([language_id.ngrams(text)])[0], want, atol=1e-6)
    assert language_id.ngrams("").size == 0


def test_ridge_solution_by_brute_force():
    """Nystroem features and weighted ridge regression, written out with plain loops and a general solver."""
    r = random.Random(12)
    rows = [(lang, " ".join("".join(r.choice(letters) for _ in range(4)) for _ in range(r.randint(2, 12)))) for lang, letters in (("aa", "abcde"), ("bb", "cdefg"), ("cc", "efghi")) for _ in range(9)]
    model = language_id.fit(rows, landmarks=9, ridge=0.01)
    k = lambda a, b: len(spectrum(a) & spectrum(b)) / (len(spectrum(a)) * len(spectrum(b))) ** 0.5
    marks = [t for name in ("aa", "bb", "cc") for lang, t in rows if lang == name][:3] + [t for lang, t in rows if lang == "bb"][:3] + [t for lang, t in rows if lang == "cc"][:3]
    among = np.array([[k(a, b) for b in marks] for a in marks])
    cross = np.array([[k(t, m) for m in marks] for _, t in rows])
    # In kernel form: coefficients w minimise sum of share * (cross w - y)^2 + ridge * w' among w.
    share = np.diag([1 / 9] * len(rows))
    for column, name in enumerate(("aa", "bb", "cc")):
        y = np.array([float(lang == name) for lang, _ in rows])
        w = np.linalg.lstsq(cross.T @ share @ cross + 0.01 * among, cross.T @ share @ y, rcond=None)[0]
        assert np.allclose(cross @ w, cross @ model.weights[:, column], atol=1e-4)


def test_byte_bpe_like_tiktoken(docs, empty):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(byte_bpe.RANKS)
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    r = random.Random(5)
    odd = ["a", "é", "\x1c", " ", "  ", "\n", "5", "٣", "漢", "'s", "'S", "!", "​", "\U0001f600", "\x85", "Ⅷ", "<|endoftext|>", "a" * 300]
    for _ in range(300):
        text = "".join(r.choice(odd) for _ in range(r.randint(0, 40)))
        assert np.frombuffer(byte_bpe.encode_text(text, byte_bpe.RANKS), "<u4").tolist() == plain.encode_ordinary(text)
    found = collect(byte_bpe.round_trip(docs))
    for i, t in TEXTS:
        ids = plain.encode_ordinary(t or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert found[i] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    back = collect(byte_bpe.decode(byte_bpe.encode(docs)))
    assert all(bytes(back[i][0]) == (t or "").encode() for i, t in TEXTS)
    assert byte_bpe.round_trip(empty).count() == 0


def test_best_fit_plan_is_best_fit_decreasing():
    r = random.Random(9)
    for _ in range(100):
        size = r.choice([7, 20, 50])
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 100))]
        bins = []
        for n in sorted(lengths, reverse=True):
            room = [(b, k) for k, b in enumerate(bins) if b >= n]
            if room:
                bins[min(room)[1]] -= n
            else:
                bins.append(size - n)
        used = {}
        for n, _, ranks, first, per, at in packing.best_fit_plan(Counter(lengths), size):
            for k in range(ranks):
                assert used.get(first + k // per, 0) == at + k % per * n
                used[first + k // per] = at + k % per * n + n
        assert sorted(size - u for u in used.values()) == sorted(bins)


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    rows = packing.pack_documents(docs, with_ids=True).collect()
    want = {}
    for i, t in TEXTS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            want[i, piece] = (at, ids[at : at + 4096])
    assert {(r["doc_id"], r["piece"]): (r["start"], r["ids"]) for r in rows} == want
    assert all(r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])) for r in rows)
    sequences = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 4096
    assert len(sequences) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.pack_documents(empty).count() == 0


def vectors():
    r = np.random.default_rng(2)
    rows = [(0, None, 1), (1, [0.0] * 8, 1), (2, [float("nan")] + [1.0] * 7, 1), (3, [1.0] * 8, None), (4, [None] + [1.0] * 7, 1), (5, [], 1), (6, [1.0, 2.0], 1), (7, [1e30] * 8, 1)]
    centres = r.standard_normal((12, 8))
    for i in range(8, 300):
        v = centres[i % 12] + r.standard_normal(8) * r.choice([0.02, 0.2, 0.6])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 2)))
    rows += [(300 + i, rows[20][1], rows[20][2]) for i in range(40)]
    return rows


@pytest.mark.parametrize("chunk", [512, 7])
def test_embedding_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    rows = vectors()
    table = spark.createDataFrame([(*x, "extra") for x in rows], "vec_id long, embedding array<float>, label int, component_id string").repartition(3)
    good = {i: np.array(v, np.float32).astype(float) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: x for i, _, x in rows}
    links = [(a, b) for a in good for b in good if a < b and label[a] == label[b] and len(good[a]) == len(good[b])
             and (good[a] / np.linalg.norm(good[a])) @ (good[b] / np.linalg.norm(good[b])) >= 0.93]
    n = Counter(x for pair in links for x in pair)
    root = reach([x[0] for x in rows], links)
    found = collect(embedding_dedup.near_vectors(table), "vec_id")
    assert set(found) == set(root)
    assert all(found[i][0] <= n[i] for i in root)  # nothing below the threshold
    assert sum(f[0] for f in found.values()) >= 0.97 * 2 * len(links)
    assert sum(found[i][1] == root[i] and found[i][2] == (root[i] == i) for i in root) >= 0.97 * len(root)
    assert [found[i] for i in range(5)] == [(0, i, True) for i in range(5)]
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def brute_passages(symbols_of, length=50):
    first, docs = {}, [(i, symbols_of(t or "")) for i, t in TEXTS]
    for i, s in docs:
        for at in range(len(s) - length + 1):
            first.setdefault(s[at : at + length], i)
    out = {}
    for i, s in docs:
        gone = bytearray(len(s))
        for at in range(len(s) - length + 1):
            if first[s[at : at + length]] < i:
                gone[at : at + length] = b"\1" * length
        out[i] = (s, gone)
    return out


@pytest.mark.parametrize("share", [128, 1])
def test_suffix_dedup(docs, empty, monkeypatch, share):
    monkeypatch.setattr(passages, "SHARE", share)
    want = {}
    for i, (s, gone) in brute_passages(str.encode).items():
        kept = bytes(b for b, g in zip(s, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(s), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    assert collect(suffix_dedup.copies_digest(docs)) == want
    assert sum(w[1] for w in want.values()) > 1000
    if share > 1:
        assert suffix_dedup.copies_digest(empty).count() == 0
        assert {r["doc_id"]: len(r["spans"]) for r in suffix_dedup.remove_copies(docs).collect()} == {i: w[2] for i, w in want.items()}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_passages():
    want = {}
    for i, (s, gone) in brute_passages(lambda t: tuple(WORD.findall(t))).items():
        kept = " ".join(w for w, g in zip(s, gone, strict=True) if not g)
        want[i] = (len(s), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return want


@pytest.mark.parametrize("batches,share", [(1, 128), (4, 1)])
def test_substring_dedup(docs, empty, monkeypatch, batches, share):
    monkeypatch.setattr(passages, "SHARE", share)
    want = word_passages()
    assert collect(substring_dedup.repeats_digest(docs, batches)) == want
    assert sum(w[1] for w in want.values()) > 100
    for i, row in collect(substring_dedup.remove_repeats(docs, batches)).items():
        assert hashlib.sha256(" ".join(WORD.findall(row[2])).encode()).hexdigest() == want[i][2]
    if batches == 1:
        assert substring_dedup.repeats_digest(empty).count() == 0


def test_fingerprint_index_is_opened_again_appended_and_compacted(spark, docs):
    want, ids = word_passages(), [i for i, _ in TEXTS]
    path = f"{passages_path(spark)}/index"
    index = substring_dedup.FingerprintIndex.create(spark, path, docs, most_runs=2)
    seen, versions = docs.where("false"), set()
    for low in range(min(ids), max(ids) + 1, 12):
        index = substring_dedup.FingerprintIndex.open(spark, path, most_runs=2)
        versions.add((index.version, index.runs))
        batch = docs.where(f"doc_id between {low} and {low + 11}")
        for i, row in collect(substring_dedup.add_documents(index, batch, seen)).items():
            assert row[:2] == want[i][:2]
            assert hashlib.sha256(" ".join(WORD.findall(row[2])).encode()).hexdigest() == want[i][2]
        seen = seen.union(batch)
    assert {(0, 0), (0, 1), (0, 2), (1, 1)} <= versions
    plan = index.stored_runs().groupBy("part").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # a batch reads the runs where they lie


def passages_path(spark):
    from gleaner.llm.common import new_path

    return new_path(spark, "test")


@pytest.mark.parametrize("run", [suffix_dedup.copies_digest, substring_dedup.repeats_digest])
def test_passages_of_rows_that_share_an_id(spark, run):
    a, b, c = prose(201, 120), prose(202, 150), prose(203, 130)
    rows = [(1, a), (2, a), (2, b), (2, b), (3, a + " " + c), (3, c), (4, None)]
    found = run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = sorted((r["doc_id"], r["kept_sha256"]) for r in found)
    after = (" " if run is suffix_dedup.copies_digest else "") + c
    assert kept == sorted([(1, digest(a)), (2, digest("")), (2, digest(b)), (2, digest(b)), (3, digest(after)), (3, digest(c)), (4, digest(""))])


def test_suffix_orders_hold_a_run_of_cores_not_a_bucket():
    """The memory of an order doesn't grow with the contexts of a bucket, and what it finds is the same."""
    r = random.Random(8)
    some = lambda n, of=b"abcdefgh": bytes(r.choices(of, k=n))
    rows, want = [], set()
    for core in range(12_000):
        window, row = some(50), core - (1 << 63)
        one, other = some(15, b"ABCD") + window + some(15, b"ABCD"), some(20, b"WXYZ") + window + some(11, b"WXYZ")
        rows += [(core, 1, row, 0, 80, one), (core, 2, row, 100 * core, 100 * core + 81, other)]
        want.add((2, core, 100 * core + 20, 100 * core + 70))
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), passages._CONTEXT_ARROW.types, strict=True)], schema=passages._CONTEXT_ARROW)
    tracemalloc.start()
    try:
        found = passages._ordered(table, "bytes")
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert {x for part in found for x in zip(*(c.tolist() for c in part), strict=True)} == want
    assert peak < 120 << 20  # all contexts in one order took 299 million bytes


def _peak(run):
    """What ``run`` returns, and the most memory that Python and numpy held meanwhile."""
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_windows_unpack_some_cores_of_a_bucket_not_all():
    """A bucket's contexts become Python's objects some cores at a time, and what is found is the same."""
    r = random.Random(9)
    bucket, want = [], set()
    for payload in range(40):
        rows = [(r.getrandbits(63), 1, i, 0, 600, r.randbytes(600)) for i in range(1000)]
        window, row = r.randbytes(50), payload - (1 << 63)
        rows += [(payload, 1, row, 0, 80, r.randbytes(30) + window), (payload, 2, row, 7, 87, window + r.randbytes(30))]
        want.add((2, payload, 7, 57))
        table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), passages._CONTEXT_ARROW.types, strict=True)], schema=passages._CONTEXT_ARROW)
        bucket.append((0, 0, passages.WHOLE, passages.fold(table)))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*bucket, strict=True), passages._SENT_ARROW.types, strict=True)], schema=passages._SENT_ARROW)
    sent, peak = _peak(lambda: list(passages._windows(iter([batch]), "bytes", 3)))
    assert {x for b in sent for x in zip(*(c.tolist() for c in passages._spans(b.column("payload").to_pylist())), strict=True)} == want
    assert peak < 40 << 20  # 24 MB of it are the payloads; all contexts at once took 56 million bytes


def test_anchors_hold_a_chunk_of_texts():
    """The memory of anchors is that of eight MB of texts, however many a task reads."""
    letters = np.random.default_rng(4).integers(97, 123, (160, 100_000), np.uint8)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i], "text": [x.tobytes().decode()]}) for i, x in enumerate(letters)]
    sent, peak = _peak(lambda: sum(b.num_rows for b in passages._anchor(iter(batches), "bytes", 20, 4, 4)))
    assert sent == 8  # two chunks for four buckets
    assert peak < 140 << 20  # all texts in one chunk took 190 million bytes


def test_contexts_of_equal_texts_are_settled_once():
    """Contexts of a group that a smaller document has in the same core go as spans; rows that share a doc_id keep theirs."""
    r = random.Random(10)
    rows = [(core, doc, row, 0, 60, text) for core in range(50) for text in (r.randbytes(60), r.randbytes(60)) for doc, row in ((7, 1), (3, 2), (3, 3), (9, 4))]
    rows += [(1000 + i, 5, i, 0, 60, r.randbytes(60)) for i in range(50)]
    r.shuffle(rows)
    table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), passages._CONTEXT_ARROW.types, strict=True)], schema=passages._CONTEXT_ARROW)
    assert passages._settled(table).tolist() == [doc in (7, 9) for _, doc, *_ in rows]


def test_longest_previous_factors_by_brute_force():
    r = random.Random(6)
    for depth in (5, 12):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 40))) for _ in range(12)]
        owner = np.array([r.randint(0, 5) for _ in texts])
        data, docs = b"".join(texts), np.repeat(owner, [len(t) for t in texts])
        order = suffixes.SuffixOrder(np.frombuffer(data, np.uint8), depth, depth >= 8)
        at = np.argsort(order.rank, kind="stable")
        share = lambda i, j: next((k for k in range(depth) if data[i + k : i + k + 1] != data[j + k : j + k + 1] or max(i, j) + k >= len(data)), depth)  # noqa: B023, E731
        common = np.r_[0, order.common_prefix(at[:-1], at[1:])].astype(np.int16)
        assert common[1:].tolist() == [share(i, j) for i, j in zip(at.tolist(), at[1:].tolist(), strict=False)]
        found = suffixes.longest_previous_factors(docs[at], common)
        for place, i in zip(found.tolist(), at.tolist(), strict=True):
            assert place == max((share(i, j) for j in range(len(data)) if docs[j] < docs[i]), default=0)


def test_previous_smaller_by_brute_force():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 100):
        values, common = r.integers(0, 9, n), r.integers(0, 50, n)
        where, least = suffixes.previous_smaller(values, common)
        for i in range(n):
            j = next((j for j in range(i - 1, -1, -1) if values[j] < values[i]), -1)
            assert where[i] == j and least[i] == (common[j + 1 : i + 1].min() if j >= 0 else 0)


def test_bucket_hash_is_sparks(spark):
    ids = [0, 1, -1, 5, 2**62, -(2**63), 12345678901]
    want = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(F.pmod(F.xxhash64("i"), F.lit(97))).collect()]
    assert passages.doc_bucket(np.array(ids), 97).tolist() == want


def test_ranks_are_suffix_order():
    data = b"banana bandana banana"
    ranks = suffixes.SuffixOrder(np.frombuffer(data, np.uint8), 11, True).rank
    cut = [data[i : i + 11] for i in range(len(data))]
    for i, a in enumerate(cut):
        for j, b in enumerate(cut):
            assert (ranks[i] < ranks[j]) == (a < b) or a.ljust(11, b"\0") == b.ljust(11, b"\0")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 4 else [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty):
    fps = {i: plain_fingerprint(t) for i, t in TEXTS}
    root = reach(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4])
    assert collect(simhash.near_classes(docs)) == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    assert {r["doc_id"] for r in simhash.drop_near(docs).collect()} == set(root.values())
    assert simhash.near_classes(empty).count() == 0


@pytest.mark.parametrize("depth,piece", [(None, 1 << 18), (1, 5), (7, 64)])
def test_near_links(spark, monkeypatch, depth, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    r = random.Random(4)
    fps = {r.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(4):
            g = f
            for b in r.sample(range(64), r.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    fps |= {0, (1 << 64) - 1, 0xF, 0x1F}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = reach(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.near_links(table, 4, depth)).collect()}
    assert {s: found.get(s, s) for s in signed} == want


def test_trie_pairs_are_all_pairs():
    r = np.random.default_rng(3)
    fps = np.unique(r.integers(0, 1 << 12, 600).astype(np.uint64) << np.uint64(50))
    a, b = simhash.trie_pairs(fps, [(0, len(fps), 0, len(fps), 0)], 63, 3)
    found = [tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)]
    want = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 3]
    assert sorted(found) == want


def test_a_large_cluster_is_grouped_without_its_pairs():
    """All values within three bits of one: 130 million linked pairs, which are never held."""
    import tracemalloc
    from itertools import combinations

    base = 0x0123456789ABCDEF
    fps = np.unique(np.array([base ^ sum(1 << b for b in bits) for k in range(4) for bits in combinations(range(64), k)], np.uint64))
    assert len(fps) == 43745
    groups = simhash.Groups(len(fps))
    tracemalloc.start()
    simhash.walk(fps, [(0, len(fps), 0, len(fps), 0)], 63, 4, groups)
    assert (groups.settle() == 0).all()
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("most", [3, 40, 1000])
def test_nodes_of_skewed_prefixes_are_split(spark, most):
    """Fingerprints that share their first bits, in whatever order bits are taken, and some that share none."""
    r = random.Random(6)
    fps = {r.getrandbits(20) for _ in range(150)} | {(0xABC << 50) | r.getrandbits(16) << 20 for _ in range(150)} | {r.getrandbits(64) for _ in range(20)} | {0, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = reach(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4])
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {x["node"]: x["root"] for x in components(simhash.near_links(table, 4, 4, most)).collect()}
    assert {s: found.get(s, s) for s in signed} == want
    order = list(range(63, -1, -1))
    nodes = simhash._nodes(table, order, 4, most)
    held = Counter(nodes.of(simhash.in_order(np.array(sorted(fps), np.uint64), order)).tolist())
    assert all(n <= most or nodes.depth[i] >= 59 for i, n in held.items())


def test_dropping_copies_leaves_one_row_of_each(spark):
    rows = [(1, "a", "x"), (1, "b", "x"), (2, "a", "y"), (3, "c", "z"), (3, "c", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, row string")
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.drop_copies(table).collect()) == [(1, "b"), (2, "a"), (3, "c")]
    near = [(1, "a b c d e", "x"), (1, "a b c d e", "y"), (2, "a b c d e", "z"), (2, "q w e r t y", "z"), (None, "a", "n")]
    found = simhash.drop_near(spark.createDataFrame(near, "doc_id long, text string, row string")).collect()
    assert sorted((r["doc_id"], r["text"]) for r in found) == [(1, "a b c d e"), (2, "q w e r t y")]


def test_line_dedup_is_linear_in_the_lines_of_a_document(spark):
    import time

    def seconds(n):
        table = spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(n))), (2, "\n".join(f"line {i}" for i in range(n - 5, n)))], "doc_id long, text string")
        began = time.time()
        found = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.delete_runs(table).select("doc_id", "n_lines", "n_removed").collect()}
        assert found == {1: (n, 0), 2: (5, 5)}
        return time.time() - began

    seconds(100)
    assert seconds(200_000) < 60  # an hour and more where it is quadratic


def test_simhash_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "y"), (1, None, "z"), (2, "a b c d e", "w")], "doc_id long, text string, fp string")
    found = simhash.near_classes(rows).collect()
    assert len(found) == 4 and {r["component_id"] for r in found} == {1}


@pytest.mark.parametrize("kind", ["bigint", "string", "array<int>"])
def test_embedding_labels_of_any_type(spark, kind):
    rows = [(1, [1.0, 0.0], 3_000_000_000), (2, [1.0, 0.01], 3_000_000_000), (3, [1.0, 0.0], 4), (3, [1.0, 0.0], 4), (4, [1.0, 0.0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long")
    label = F.col("label").cast(kind) if kind != "array<int>" else F.when(F.col("label").isNotNull(), F.array((F.col("label") % 1000).cast("int")))
    found = embedding_dedup.near_vectors(table.withColumn("label", label)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (3, 1, 3), (4, 0, 4)]


def test_cells_that_collide_are_told_apart():
    """Vectors of different labels, tables or buckets in one cell do not meet."""
    import pyarrow as pa

    v = np.array([1.0, 0.0], np.float32).tobytes()
    rows = [("a", 0, 5, 1), ("b", 0, 5, 2), ("a", 1, 5, 3), ("a", 0, 6, 4), ("a", 0, 5, 5)]
    columns = {"cell": [1] * 5, "side": [0] * 5, "label": [x[0] for x in rows], "table": [x[1] for x in rows], "bucket": [x[2] for x in rows],
               "size": [2] * 5, "id": [x[3] for x in rows], "n": [1] * 5, "vector": [v] * 5, "keys": [np.array([5, 5]).tobytes()] * 5}
    found = [r for b in embedding_dedup._check(iter([pa.RecordBatch.from_pydict(columns)]), 0.9) for r in b.to_pylist()]
    assert found == [{"id": 1, "add": 1, "first": 1}, {"id": 5, "add": 1, "first": 1}]


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = reach(nodes, edges_of := [e for e in edges if e[0] != e[1]])
    assert edges_of
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == want


@pytest.mark.parametrize("least", [0, 20])
def test_warc(spark, tmp_path, least):
    htmls = ["same \r\n\r\nWARC/1.1 é", None, "", "unique", "same \r\n\r\nWARC/1.1 é", "x" * 50_000, "same \r\n\r\nWARC/1.1 é", "unique2", "short", "short"]
    rows = [(i, None if i == 3 else f"http://e.com/\n{i}", h, "x") for i, h in enumerate(htmls)]
    pages = spark.createDataFrame([*rows, (None, "u", "lost", "x")], "page_id long, url string, html string, record_type string").repartition(3)
    groups = {}
    for i, h in enumerate(htmls):
        groups.setdefault((h or "").encode(), []).append(i)
    want = {}
    for payload, ids in groups.items():
        for i in ids:
            revisit = len(payload) >= least and i < max(ids)
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            want[i] = (len(payload), digest, "revisit" if revisit else "response", max(ids) if revisit else None)
    found = warc.deduplicate_pages(pages, least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collect(found, "page_id") == want
    assert warc.deduplicate_pages(pages.limit(0)).count() == 0


def test_warc_keeps_the_payloads_of_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(warc, "LARGE_BYTES", 12)
    rows = [(5, "u", "shared payload"), (5, "u", "a payload of its own"), (9, "v", "shared payload"), (9, "v", "shared payload"), (1, None, "small")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    date, source, target = "2024-01-01T00:00:00Z", warc.new_path(spark, "s"), warc.new_path(spark, "t")
    most = warc.write_responses(pages, source, date)
    assert most == {"usual": 500, "large": 500}
    warc.resolve_revisits(spark, source, target, date, most)
    records = [r for row in warc.archive_files(spark, target).collect() for r in warc.parse_archive(bytes(row["content"]))]
    assert len({h["WARC-Record-ID"] for h, _ in records}) == 5
    payloads = sorted(block.split(b"\r\n\r\n", 1)[1] for h, block in records if h["WARC-Type"] == "response")
    assert payloads == [b"a payload of its own", b"shared payload", b"small"]
    originals = {h["WARC-Record-ID"] for h, _ in records if h["WARC-Type"] == "response"}
    revisits = [h for h, _ in records if h["WARC-Type"] == "revisit"]
    assert len(revisits) == 2 and all(h["WARC-Refers-To"] in originals and h["Refers-To-Page-Id"] == "9" for h in revisits)


def test_word_ids_are_the_librarys_for_every_character():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    r = random.Random(1)
    odd = ["%%", "&", "*#$", "Word", "word,%", "É.", "a", "B", "É", "Σ", "ΑΣ", "İ", " ", "\t", "\n", "\x1c", "\x85", "'s", "'S", ".", ",", "!?", "5", "٣", "漢", "<|endoftext|>", "\U0001f600", "\u0301", "ß", "x" * 90]
    texts = [f"a{chr(c)}b {chr(c)} A{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += ["".join(r.choice(odd) for _ in range(r.randint(0, 25))) for _ in range(10_000)]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        assert list(encoder.packed(part)) == want


def test_packing_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (2, None)], "doc_id long, text string")
    found = packing.pack_documents(rows).collect()
    assert len(found) == 4 and len({(r["sequence_id"], r["offset"]) for r in found}) == 4


def test_line_dedup_rows_that_share_an_id(spark):
    text = "a\nb\nc\nd"
    rows = [(1, text, 0, "m"), (2, text, 1, "m"), (2, "u1\nu2\nu3\nu4", 2, "m"), (2, None, 3, None), (3, text + "\ne", 4, "m"), (3, text + "\ne", 5, "m")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_removed long, marks string")
    found = line_dedup.delete_runs(table.withColumn("row", F.lit(7)).withColumn("doc", F.lit("x"))).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in found) == [(1, text), (2, ""), (2, ""), (2, "u1\nu2\nu3\nu4"), (3, "e"), (3, "e")]
    assert {r["row"] for r in found} == {7} and {r["doc"] for r in found} == {"x"}


def test_winnowing_indexes_selected_lines_only(spark):
    lines = [f"line {i * 7919 % 1000}" for i in range(400)]
    index = line_dedup.selected_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).collect()
    assert 0.35 * len(lines) < len(index) < 0.65 * len(lines)
    at = sorted(r["at"] for r in index)
    assert at[0] < line_dedup.RUN and all(b - a <= line_dedup.RUN for a, b in zip(at, at[1:], strict=False))


def test_one_huge_page_makes_few_files_of_the_others(spark, tmp_path):
    r = random.Random(2)
    middle = "".join(r.choice("abcdefgh") for _ in range(140 << 10))
    rows = [(i, f"http://h/{i}", f"{i} {middle}") for i in range(299)] + [(299, "http://h/299", middle * 290), (300, "u", None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    most = warc.write_responses(table, f"{tmp_path}/a", "2024-01-01T00:00:00Z")
    assert set(most) == {"usual", "large", "large-3"}
    assert warc.archive_files(spark, f"{tmp_path}/a").count() <= 8
    found = warc.read_headers(spark, f"{tmp_path}/a").collect()
    assert sorted((x["page_id"], x["payload_bytes"]) for x in found) == [(i, len(h or "")) for i, _, h in rows]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) in (int(before), warc.BATCH_ROWS)


def test_long_pre_tokens_are_not_remembered(spark):
    """Unique pre-tokens of 10 KB leave nothing behind, and rows that repeat give a row each."""
    r = random.Random(9)
    memory = byte_bpe._coder(byte_bpe.RANKS)[1]
    for _ in range(20):
        byte_bpe.encode_text("".join(r.choice("abcdefghijklmnop") for _ in range(10_000)), byte_bpe.RANKS)
    assert max(map(len, [*memory, *memory.old]), default=0) <= byte_bpe.LONGEST
    rows = spark.createDataFrame([(1, "same text"), (1, "same text"), (2, None)], "doc_id long, text string")
    found = byte_bpe.round_trip(rows).collect()
    assert len(found) == 3 and len({tuple(x) for x in found}) == 2


@pytest.mark.parametrize("kind, gram", [("bytes", suffix_dedup.GRAM), ("words", substring_dedup.GRAM)])
def test_grams_that_meet_by_chance_ask_for_no_texts(spark, kind, gram):
    r = random.Random(8)
    joint = "" if kind == "bytes" else " "
    some = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") if kind == "bytes" else f"w{r.randrange(10**6)}" for _ in range(n)]
    # Runs of half a window recur everywhere, those of half a window and a gram nowhere.
    runs = [some(passages.LENGTH // 2 + 5) for _ in range(20)]
    chance = [(i, joint.join(joint.join([*some(30), *run]) for run in r.sample(runs, 10))) for i in range(30)]
    # Whole windows, cut out of passages at every offset to the anchors.
    passage = some(300)
    whole = [(100 + k, joint.join([*some(40), *passage[k : k + passages.LENGTH], *some(40)])) for k in range(200)] + [(99, joint.join(passage))]

    def asked(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        dealt = passages.buckets(docs)
        found = passages.resolve(passages.anchors(docs, kind, gram, dealt), dealt[1]).where(F.col("kind") == passages.TEXTS).collect()
        return {(int(d), int(p)) for d, _, p, _ in zip(*passages._spans([x["payload"] for x in found]), strict=True)}

    assert not asked(chance)
    assert {d for d, _ in asked(whole)} == {99, *range(100, 300)}
    digest = suffix_dedup.copies_digest if kind == "bytes" else substring_dedup.repeats_digest
    gone = {x["doc_id"]: x["n_removed"] for x in digest(spark.createDataFrame([*chance, *whole], "doc_id long, text string")).collect()}
    assert all(gone[i] == 0 for i in range(30)) and gone[99] == 0
    assert all(gone[100 + k] >= passages.LENGTH for k in range(200))
