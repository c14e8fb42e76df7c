"""Spelling variants, lexical search and packing in groups against plain versions."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm import group_packing, lexical_search, spelling
from tests.llm.test_operators import SCHEMA, TEXTS, prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts):
    rows = [(i, t, "en", "s", 1, 1, 2, "x") for i, t in texts]
    return spark.createDataFrame([*rows, (None, "no id here at all", "en", "s", 5, 1, 2, "x")], SCHEMA).repartition(3)


def spelled():
    """Words with frequent and rare neighbours of all kinds, chains of forms, letters beyond ASCII and ties."""
    frequent = {"received": 300, "receives": 25, "receive": 24, "naïveté": 40, "NAÏVETÉ": 3, "lettering": 2, "aaaaaaaa": 60, "aaaaaaa": 5, "Straßenbahn": 50, "banana×split": 20}
    rare = {"recieved": 3, "receved": 2, "receiveds": 2, "naívetè": 2, "naîveté": 2, "aaaaaaaaa": 3, "Strassenbahn": 4, "Strasenbahn": 2, "Strabenbahn": 2, "banana÷split": 2, "short": 90, "abcdefg": 1}
    words = [w for part in (frequent, rare) for w, n in part.items() for _ in range(n)]
    r = np.random.default_rng(1)
    r.shuffle(words)
    texts = [" ".join(words[i : i + 40]) + "!" for i in range(0, len(words), 40)]
    return list(enumerate(["", None, " ", "x", "日本received本", *texts, texts[0], texts[0]], 1)) + [(7, texts[1]), (7, texts[1])]


def plain_variants(texts):
    counts = Counter()
    for doc_id, text in texts:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                counts[word] += 1
    counts = {w: n for w, n in counts.items() if n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w, n in counts.items():
        around = sorted((-counts[v], v) for v in counts if near(w, v))
        n_near[w] = len(around)
        form[w] = around[0][1] if around and -around[0][0] >= 10 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, n_near[w], counts[form[w]] if form[w] else None)
    return out


@pytest.mark.parametrize("pass_bytes", [32 << 20, 2 * 8 * spelling.CHUNK])
def test_spelling_variants(spark, pass_bytes):
    for texts in (spelled(), TEXTS):
        want = plain_variants(texts)
        rows = spelling.variants(table(spark, texts), pass_bytes).collect()
        assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == want
        assert len(rows) == len(want)
    assert any(f and r != f for f, r, *_ in plain_variants(spelled()).values())
    assert spelling.variants(table(spark, [])).count() == 0


def test_spelling_texts_of_one_stretch_or_more(spark, monkeypatch):
    text = " ".join(prose(i, 60) for i in range(30)) + "é" * 5000 + " " + "x" * 300
    want = plain_variants([(1, text), (2, text)])
    for stretch in (64, 1 << 20):
        monkeypatch.setattr(spelling, "STRETCH", stretch)
        assert [w for s in spelling._stretches(text) for w in re.findall(rb"[a-z\xc0-\xff]+", s)] == [w.translate(LOWER).encode("latin-1") for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
    rows = spelling.variants(table(spark, [(1, text), (2, text)])).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == want


def test_filters_lose_nothing_and_let_little_through():
    r = np.random.default_rng(2)
    words = np.unique(r.integers(97, 123, (20000, 9)).astype(np.uint8), axis=0)
    blocks = {9: len(words) // spelling.TO_BLOCK}
    h = spelling._mixed(((words.astype(np.uint64) + np.uint64(1)) * spelling._powers(9)).sum(axis=1, dtype=np.uint64))
    bits = np.zeros(-(-blocks[9] // spelling.CHUNK) * spelling.CHUNK, np.uint64)
    np.bitwise_or.at(bits, spelling._block(h, blocks[9]), spelling._bits(h))
    prober = spelling.Prober({9: (0, bits)}, blocks, bytes(range(97, 123)))
    found = set()
    for w, p, c in prober.edits(words[:300]):
        found |= {(int(a), int(b), int(x)) for a, b, x in zip(w, p, c, strict=True)}
    there = {w.tobytes() for w in words}
    want = {(i, p, c) for i, w in enumerate(words[:300]) for p in range(9) for c in range(w[p] + 1, 123) if w.tobytes()[:p] + bytes((c,)) + w.tobytes()[p + 1 :] in there}
    assert want <= found
    assert len(found - want) < 0.01 * 300 * 9 * 13


def plain_search(items, docs, top=50):
    rx = re.compile(lexical_search._TERM)
    terms = {}
    for i, t in items:
        if i is not None:
            terms.setdefault(i, set()).update(rx.findall((t or "").translate(LOWER)))
    counts = [(i, Counter(rx.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, wanted in terms.items():
        scored = []
        for doc, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block_items", "stretch"), [(4096, 1 << 20), (3, 50)])
def test_lexical_search(spark, monkeypatch, block_items, stretch):
    monkeypatch.setattr(lexical_search, "STRETCH", stretch)
    items = [(1, "The an ring"), (2, None), (3, ""), (4, "nothing_like-this zzzz"), (5, "LINE 7 one"), (6, "ÜRE Üré ré 😀"), (7, "same text"), (7, "a b"), (None, "the"), (8, prose(3, 40)), (9, "line ré tail the")]
    docs = [*TEXTS, (10, "same TEXT"), (10, "same TEXT"), (99, "an\x00an\x7fan an-an_an ring;an" + "q" * 200), (100, "lİne line line")]
    table_of_items = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as score", "'x' as term", "2 as task")
    for top in (2, 50):
        rows = lexical_search.search(table_of_items, table(spark, docs), top, block_items).collect()
        assert sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows) == plain_search(items, docs, top)
    assert lexical_search.search(table_of_items.limit(0), table(spark, docs)).count() == 0
    assert lexical_search.search(table_of_items, table(spark, [])).count() == 0


def test_best_keeps_ties_by_document():
    r = np.random.default_rng(3)
    best, docs, scores = lexical_search.Best(4, 3), r.permutation(5000), r.integers(0, 6, (5000, 4))
    for at in range(0, 5000, 7):
        best.add(docs[at : at + 7], scores[at : at + 7])
        if at % 5 == 0:
            best.settle()
    item, score, doc = best.settle()
    for i in range(4):
        want = sorted((-s, d) for s, d in zip(scores[:, i].tolist(), docs.tolist(), strict=True))[:3]
        assert [(-s, d) for s, d in zip(score[item == i].tolist(), doc[item == i].tolist(), strict=True)] == want


def test_first_fit_tree_is_first_fit_decreasing():
    r = np.random.default_rng(4)
    for _ in range(30):
        size = int(r.integers(1, 60))
        lengths = sorted(r.integers(1, size + 1, r.integers(1, 200)).tolist(), reverse=True)
        room, plain = [], []
        for i, n in enumerate(lengths):
            at = next((k for k, x in enumerate(room) if x >= n), len(room))
            if at == len(room):
                room.append(size)
                plain.append([])
            room[at] -= n
            plain[at].append(i)
        found = group_packing.first_fit_decreasing(lengths, size)
        assert found == plain
        parts = group_packing.levelled(found, lengths, size)
        fills = [sum(n for _, _, n in s) for s in parts]
        assert all(f == size or f & (f - 1) == 0 for f in fills) and sum(f < size for f in fills) <= size.bit_length()
        covered = defaultdict(list)
        for s in parts:
            for i, at, n in s:
                covered[i] += range(at, at + n)
        assert {i: sorted(x) for i, x in covered.items()} == {i: list(range(n)) for i, n in enumerate(lengths)}


@pytest.mark.parametrize("group_bytes", [20_000, group_packing.GROUP_BYTES])
def test_packing_in_groups(spark, group_bytes):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(group_packing.TOKENIZER))
    texts = [*TEXTS, (10, None), (10, None), (500, prose(9, 9000))]
    size = group_packing.SIZE
    rows = group_packing.pack_in_groups(table(spark, texts), with_ids=True, group_bytes=group_bytes).collect()
    want = defaultdict(Counter)
    for i, t in texts:
        for at, x in enumerate([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]):
            want[i][at, x] += 1
    found = defaultdict(Counter)
    sequences = defaultdict(list)
    for r in rows:
        assert len(r["ids"]) == r["length"] > 0 and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"]))
        assert r["start"] + r["length"] <= r["doc_tokens"]
        found[r["doc_id"]].update((r["start"] + k, x) for k, x in enumerate(r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    plain = group_packing.pack_in_groups(table(spark, texts), group_bytes=group_bytes).drop("sequence_id").collect()
    assert sorted(tuple(r) for r in plain) == sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["offset"]) for r in rows)
    assert group_packing.pack_in_groups(table(spark, [])).count() == 0
