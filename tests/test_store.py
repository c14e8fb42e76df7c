"""Versions, states in place, parsers that fail, the census of a write, lists, drives."""

import json

import pytest
from pyspark.sql import functions as F

from gleaner.operators import commands, fanout, linkstate, workflows
from gleaner.sources import readers, store, versions

FIELDS = "http_status: int, last_checked: string, verified_via: string"


def states(spark, path):
    return {r["url"]: (r["http_status"], r["last_checked"], r["verified_via"]) for r in readers.link_states(spark, path, FIELDS).collect()}


def test_sweep_in_place_twice(spark, tmp_path):
    path = f"{tmp_path}/states"
    assert states(spark, path) == {}  # not there yet
    probed = spark.createDataFrame([("a", 200), ("b", 404)], "url string, status int")
    (tmp_path / "states").mkdir()
    (tmp_path / "states" / "old.json").write_text(json.dumps({"a": {"http_status": 500, "last_checked": "d0", "verified_via": None}, "s": {"http_status": 200, "last_checked": "d0", "verified_via": "fetch_js"}}))
    assert set(states(spark, path)) == {"a", "s"}
    assert commands.sweep_files(spark, path, probed, "d1", FIELDS)["version"] == 1
    assert states(spark, path) == {"a": (200, "d1", None), "s": (200, "d1", "fetch_js")}
    probed = spark.createDataFrame([("a", 410)], "url string, status int")
    done = commands.sweep_files(spark, path, probed, "d2", FIELDS)
    assert done == {"version": 2, "written": 2}
    assert states(spark, path) == {"a": (410, "d2", None), "s": (200, "d2", "fetch_js")}
    earlier = readers.link_states(spark, path, FIELDS, version=1)
    assert {r["last_checked"] for r in earlier.collect()} == {"d1"}


def test_a_write_that_fails_leaves_the_old_version(spark, tmp_path):
    path = f"{tmp_path}/v"
    versions.write(spark.range(5), path)
    broken = versions.read(spark, path, "id long").withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        versions.write(broken, path)
    assert versions.latest(spark, path) == 1
    assert versions.read(spark, path, "id long").count() == 5
    done = versions.update(spark, path, "id long", lambda rows: rows.where("id < 2"))
    assert done == {"version": 2, "written": 2}
    assert versions.read(spark, path, "id long").count() == 2 and versions.read(spark, path, "id long", 1).count() == 5
    assert versions.write(spark.range(0), path)["written"] == 0 and versions.read(spark, path, "id long").count() == 0


def test_the_second_of_two_writers_is_told(spark, tmp_path):
    path = f"{tmp_path}/v"
    versions.write(spark.range(1), path)
    base = versions.latest(spark, path)
    versions.write(spark.range(2), path, base=base)
    with pytest.raises(versions.ConcurrentWrite):
        versions.write(spark.range(3), path, base=base)
    # Both published the same number: the smaller id is the version for every reader.
    spark.createDataFrame([(3, "0" * 32, "parquet", 9, None), (3, "f" * 32, "parquet", 8, None)], versions._MANIFEST).write.mode("append").json(f"{path}/manifest")
    assert versions.manifest(spark, path).where("version = 3").first()["rows"] == 9


def fussy(body):
    if "7" in body:
        raise ValueError(f"cannot read {body}")
    return None if "8" in body else {"title": body, "id": "own"} if "9" in body else {"title": body}


def test_a_parser_that_fails_loses_only_its_page(spark, tmp_path):
    pages = spark.createDataFrame([(str(i), f"page {i}") for i in range(10)], "id string, body string").repartition(3)
    meta = spark.createDataFrame([("1", "http://h/1", None)], "id string, url string, fetched_at timestamp")
    parsed = store.harvest(pages, fussy, f"{tmp_path}/raw", f"{tmp_path}/parsed", meta)
    rows = {r["id"]: r for r in parsed.collect()}
    assert len(rows) == 10 and spark.read.parquet(f"{tmp_path}/raw").count() == 10
    assert rows["7"]["error"] == "ValueError: cannot read page 7" and rows["7"]["record"] is None and rows["7"]["bytes"] == 0
    assert all(r["error"] is None for i, r in rows.items() if i != "7")
    assert json.loads(rows["3"]["record"]) == {"id": "3", "title": "page 3"} and json.loads(rows["8"]["record"]) == {"id": "8"}
    assert json.loads(rows["9"]["record"])["id"] == "own"
    assert rows["1"]["url"] == "http://h/1"
    assert [r["id"] for r in store.pending(pages.select("id"), parsed).collect()] == ["7"]
    mended = {r["id"]: r for r in store.reparse(pages, parsed, lambda body: {"t": body, "url": "new"} if "2" in body else {"t": body}).collect()}
    assert all(r["error"] is None for r in mended.values())
    assert mended["1"]["url"] == "http://h/1" and mended["2"]["url"] == "new" and mended["3"]["url"] is None


def test_the_census_comes_with_the_write(spark, tmp_path):
    records = spark.createDataFrame([("a", 1), ("b", 2), ("x", 3)], "id string, v int")
    worklist = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",)], "id string")
    path = f"{tmp_path}/applied"
    dry = store.write_applied(records, worklist, path, dry_run=True)
    assert (dry["written"], dry["missing"], dry["extra"], dry["ok"], dry["dry_run"], dry["version"]) == (2, 2, 1, False, True, None)
    assert versions.latest(spark, path) == 0
    done = store.write_applied(records, worklist, path)
    assert {**done, "dry_run": True, "version": None} == dry and done["version"] == 1
    assert sorted(tuple(r) for r in versions.read(spark, path, "id string, v int").collect()) == [("a", 1), ("b", 2)]
    kept = versions.read(spark, path, "id string, v int")  # applied again onto itself
    again = store.write_applied(kept, kept.select("id"), path)
    assert again["ok"] and again["written"] == 2 and again["version"] == 2
    assert store.write_applied(records.limit(0), worklist, path)["written"] == 0


def test_recovered_replies_are_files_with_an_index(spark, tmp_path):
    results = spark.createDataFrame([("a1", "first\nline", "p1", "i1"), ("a2", "two", "p2", "i2"), ("a3", "later", "p3", "i2")], "agent_id string, text string, source string, item_id string")
    store.write_replies(results, f"{tmp_path}/r")
    index = spark.read.schema("item_id string, agent_id string").json(f"{tmp_path}/r/index")
    found = readers.replies(spark, f"{tmp_path}/r/replies", index, "/stem=([^/]*)/")
    assert sorted((r["agent_id"], r["item_id"], r["text"].rstrip("\n")) for r in found.collect()) == [("a1", "i1", "first\nline"), ("a3", "i2", "later")]


def test_many_replies_are_written_by_several_tasks(spark, tmp_path):
    """A file to each item takes its time however small it is; before, Spark made one task of them all."""
    rows = spark.range(40).selectExpr("concat('a', id) as agent_id", "concat('text ', id) as text", "cast(id as string) as source", "concat('i', id) as item_id")
    store.write_replies(rows, f"{tmp_path}/r")
    files = [f for f in (tmp_path / "r" / "replies").rglob("part-*") if not f.name.endswith(".crc")]
    assert {f.parent.name for f in files} == {f"stem=i{i}" for i in range(40)} and len(files) == 40
    assert len({f.name.split("-")[1] for f in files}) > 1 and (tmp_path / "r" / "replies" / "_SUCCESS").exists()


def test_work_lists_with_keyless_entries_are_refused(spark):
    items = spark.createDataFrame([(0, "a"), (1, None), (2, "")], "ordinal long, id string")
    assert readers.keyless(items).count() == 2
    with pytest.raises(Exception, match="without a key at 1|without a key at 2"):
        readers.keyed(items).collect()
    assert readers.keyed(items.where("ordinal = 0")).count() == 1


def test_lists_are_bounded(spark):
    rows = spark.createDataFrame([("hot" if i % 10 else None, i * 7919 % 5003) for i in range(5003)], "g string, o long")
    found = fanout.lists(rows, "g", "o", "o", 100).collect()
    for g in ("hot", None):
        mine = sorted((r["part"], r["values"]) for r in found if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine))) and {len(v) for _, v in mine[:-1]} == {100}
        assert [x for _, v in mine for x in v] == sorted(r["o"] for r in rows.where(F.col("g").eqNullSafe(g)).collect())
    assert all(r["n"] == len(r["values"]) for r in found)
    hosts = linkstate.host_buckets(spark.createDataFrame([(1, "http://A/x"), (0, "http://a/y"), (2, "http://b/")], "ordinal long, url string"), "ordinal")
    assert sorted((r["host"], r["urls"]) for r in hosts.collect()) == [("a", ["http://a/y", "http://A/x"]), ("b", ["http://b/"])]


def test_drive_skips_stops_and_paces(spark):
    items = spark.createDataFrame([(c, i) for i, c in enumerate("abcdef")], "id string, ordinal long")
    parsed = spark.createDataFrame([("a", 10), ("b", 0)], "id string, bytes long")
    made = [("b", 1, False, 500), ("b", 2, True, 200), ("c", 1, False, 404), ("c", 2, False, 404), ("c", 3, False, 404), ("c", 4, True, 200), ("d", 1, True, 200), ("e", 1, False, 403), ("f", 1, True, 200)]
    attempts = spark.createDataFrame([(0, at, *row, f"u{at}", "", None) for at, row in enumerate(made)], "run int, at int, id string, attempt int, ok boolean, status int, url string, body string, error string")
    outcome, lists, stops = commands.drive(items, attempts, parsed, "run", ["at"])
    found = {r["id"]: r for r in outcome.collect()}
    assert {i: (r["state"], r["attempt"], r["waited_s"]) for i, r in found.items()} == {
        "a": ("skipped", None, None), "b": ("done", 2, 30), "c": ("failed", None, 60), "d": ("done", 1, 0), "e": ("failed", None, 0), "f": ("not reached", None, None),
    }
    assert found["b"]["pause_s"] is None and all(11 <= found[i]["pause_s"] <= 15 for i in "cde")
    assert {r["state"]: r["items"] for r in lists.collect()} == {"skipped": ["a"], "done": ["b", "d"], "failed": ["c", "e"], "not reached": ["f"]}
    assert stops.first()["reason"] == "refused 1x (limit 1); last status 403 on u7"


def test_pauses_are_drawn_once_and_for_all(spark):
    rows = spark.range(200).selectExpr("id % 3 as g", "id as o")
    one, two = ({(r["g"], r["o"]): r["pause_s"] for r in workflows.drawn_pauses(x, "g", "o", seed=s).collect()} for x, s in ((rows, 1), (rows.repartition(7), 1)))
    assert one == two and sum(v is None for v in one.values()) == 3
    drawn = [v for v in one.values() if v is not None]
    assert all(11 <= v <= 15 for v in drawn) and len(set(drawn)) == len(drawn)
    assert {(r["g"], r["o"]): r["pause_s"] for r in workflows.drawn_pauses(rows, "g", "o", seed=2).collect()} != one


def plain_starts(sizes, slots, interval):
    import heapq

    free, starts = [0.0] * slots, []
    for n in sizes:
        starts.append(free[0])
        heapq.heapreplace(free, free[0] + (n - 1) * interval)
    return starts


def test_queues_begin_as_if_taken_one_by_one():
    import random
    from collections import Counter

    r = random.Random(3)
    for _ in range(300):
        sizes = sorted((r.choice([1, 2, 3, r.randint(1, 40)]) for _ in range(r.randint(1, 120))), reverse=True)
        slots = r.randint(1, 12)
        plan, found, rank = linkstate.longest_first(Counter(sizes), slots, 0.5), [], Counter()
        for n in sizes:
            k, starts = rank[n], plan[n]
            rank[n] += 1
            beyond = k - len(starts)
            found.append(starts[k] if beyond < 0 else starts[len(starts) - slots + beyond % slots] + (beyond // slots + 1) * (n - 1) * 0.5)
        assert found == plain_starts(sizes, slots, 0.5)


def test_hosts_run_side_by_side_up_to_a_cap(spark):
    links = [(i, f"http://h{i % 7}.test/{i}") for i in range(40)] + [(100 + i, f"http://big.test/{i}") for i in range(30)] + [(200, "no address"), (201, None)]
    rows = spark.createDataFrame(links, "ordinal long, url string")
    for cap in (1, 2, 5, 32):
        found = linkstate.host_plan(rows, "ordinal", 0.5, cap).collect()
        assert len(found) == len(links)
        by_host = {}
        for x in sorted(found, key=lambda x: x["ordinal"]):
            by_host.setdefault(x["host"], []).append(x)
        spans = []
        for xs in by_host.values():
            assert [x["slot"] for x in xs] == list(range(len(xs)))
            assert [round(x["starts_s"] - xs[0]["starts_s"], 6) for x in xs] == [0.5 * k for k in range(len(xs))]
            spans.append((xs[0]["starts_s"], xs[-1]["starts_s"]))
        for at, _ in spans:
            assert sum(a <= at < b for a, b in spans) <= cap
        order = sorted(by_host.values(), key=lambda xs: (-len(xs), xs[0]["ordinal"]))
        assert [xs[0]["starts_s"] for xs in order] == plain_starts([len(xs) for xs in order], min(cap, len(order)), 0.5)


def png(pixels):
    """A picture of rows of (r, g, b)."""
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_are_decoded_and_judged(spark, tmp_path):
    from gleaner.operators import media

    grey, busy = [(128, 128, 128)] * 16, [(k * 37 % 256, k * 91 % 256, k * 53 % 256) for k in range(16)]
    files = {"whole": [busy] * 100, "filled": [busy] * 50 + [grey] * 50, "last": [busy] * 95 + [grey] * 5, "tinted": [[(128, 128, 20)] * 16] * 100}
    for name, rows in files.items():
        (tmp_path / f"{name}.jpg").write_bytes(png(rows))
    (tmp_path / "broken.jpg").write_bytes(png([busy] * 100)[:60])
    found = {r["path"].rsplit("/", 1)[1]: r for r in media.inspect_images(readers.images(spark, str(tmp_path))).collect()}
    assert {n: r["bad"] for n, r in found.items()} == {"whole.jpg": False, "filled.jpg": True, "last.jpg": False, "tinted.jpg": False, "broken.jpg": True}
    assert found["broken.jpg"]["reason"] == "undecodable" and "lower bands" in found["filled.jpg"]["reason"]
    assert media.inspect_images(readers.images(spark, str(tmp_path)).where("path is null")).count() == 0


def test_robots_rules_equal_a_loop_over_all(spark):
    import random
    import re

    from gleaner.operators import robots

    r = random.Random(5)
    word = lambda: "".join(r.choice("ab/?.") for _ in range(r.randint(0, 4)))
    files, links, want = [], [], {}
    for o in range(12):
        said = []
        for _ in range(r.randint(0, 12)):
            pattern = r.choice(["/", "/", "*", ""]) + word() + r.choice(["", "", "*" + word(), "$"])
            said.append((r.choice(["allow", "disallow"]), pattern))
        files.append((f"http://o{o}", "User-agent: *\n" + "\n".join(f"{k}: {v}" for k, v in said)))
        rules = []
        for k, v in said:
            if v or k == "allow":
                p = v if v[:1] in ("/", "*") else "*" + v
                body, end = (p[:-1], "$") if p.endswith("$") else (p, "")
                rules.append((len(v), k == "allow", re.compile("^" + ".*".join(map(re.escape, body.split("*"))) + end)))
        for i in range(25):
            path = "/" + word() + word()
            best = max(((n, allow) for n, allow, x in rules if x.search(path)), default=(0, True))
            links.append((len(links), f"http://o{o}", f"http://o{o}{path}"))
            want[links[-1][0]] = path, best[1]
    table = spark.createDataFrame(links, "id long, origin string, url string")
    paths = {x["id"]: x["p"] for x in table.select("id", robots.U.robots_path("url").alias("p")).collect()}
    found = robots.allowed(table, spark.createDataFrame(files, "origin string, robots string"), "any").collect()
    assert len(found) == len(links)
    same = {i for i, (path, _) in want.items() if paths[i] == path}
    assert len(same) > 150
    assert {x["id"]: x["allowed"] for x in found if x["id"] in same} == {i: want[i][1] for i in same}
