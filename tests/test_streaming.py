"""Streams whose rows fall into batches at random against the batch operators."""

import json
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.functions import constants as K
from gleaner.operators import circuit, transcripts
from gleaner.streaming import attempts, gate, windows
from gleaner.streaming import breaker as stream_breaker
from gleaner.streaming import transcripts as stream_transcripts
from gleaner.streaming.ordered import started

BEGIN = datetime(2024, 1, 1)
#: A row so late in time that the watermark passes all others.
LAST = BEGIN + timedelta(days=400)


@pytest.fixture
def stream(spark, tmp_path):
    """A stream of rows that come in the given batches, one after the other."""

    def made(batches, schema):
        folder = f"{tmp_path}/{uuid.uuid4().hex}"
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return made


def result(spark, out, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    started(out, path).awaitTermination(300)
    return spark.read.schema(out.schema).parquet(f"{path}/out").collect()


def shuffled(rows, seed, parts=5):
    r = random.Random(seed)
    batches = [[] for _ in range(parts)]
    for row in rows:
        r.choice(batches).append(row)
    for b in batches:
        r.shuffle(b)
    return [b for b in batches if b]


def outcomes(n_runs=6, n=40):
    r = random.Random(5)
    rows = []
    for run in range(n_runs):
        for seq in range(n):
            status = r.choice([200, 200, 200, 404, 429, 503, -1] if run else [200, 429]) if seq % 37 != 36 else 403
            rows.append((str(run), BEGIN + timedelta(seconds=60 * seq + run), seq, status, f"http://h/{run}/{seq}", "fine", "timed out" if status == -1 else None))
    return rows


def test_breaker_is_independent_of_batches(spark, stream, tmp_path):
    schema = "run string, ts timestamp, seq long, status int, url string, body string, error string"
    rows = outcomes()
    last = [("last", LAST, 0, 403, "http://last", "", None)]
    kinds = spark.createDataFrame(rows, schema).withColumn("kind", circuit.classify("status", "body", "error"))
    trips = circuit.trips(kinds, "run", ["seq"])
    counted = circuit.counters(kinds, "run", ["seq"]).join(trips.select("run", F.col("seq").alias("trip")), "run", "left").where("kind is not null and (trip is null or seq <= trip)")
    want = sorted((r["run"], r["seq"], r["kind"], r["seq"] == r["trip"], r["n_refused"], r["n_throttled"], r["n_unreachable"]) for r in counted.collect())
    reasons = {r["run"]: r["reason"] for r in trips.collect()}
    assert len(reasons) > 3 and all(f"/{run}/" in x and "(limit" in x for run, x in reasons.items())
    for seed in (1, 2):
        found = result(spark, stream_breaker.watch(stream([*shuffled(rows, seed), last], schema), "30 days"), tmp_path)
        assert sorted((r["run"], r["seq"], r["kind"], r["opened"], r["n_refused"], r["n_throttled"], r["n_unreachable"]) for r in found) == want
        assert {r["run"]: r["reason"] for r in found if r["opened"]} == reasons
        assert all((r["reason"] is not None) == r["opened"] for r in found)


def test_rows_at_the_watermark_count_and_rows_behind_it_do_not(spark, stream, tmp_path):
    schema = "run string, ts timestamp, seq long, status int, url string, body string, error string"
    row = lambda run, minutes, seq: (run, BEGIN + timedelta(minutes=minutes), seq, 429, "u", "", None)
    batches = [[row("a", 0, 1), row("b", 60, 1)], [row("b", 61, 2), row("b", 120, 3)], [row("b", 121, 4)], [row("a", 10, 2)], [row("c", 180, 1)]]
    found = result(spark, stream_breaker.watch(stream(batches, schema), "1 hour"), tmp_path)
    # The last watermark is at 120 minutes; the second row of a came two batches after the one that moved it to 60.
    assert sorted((r["run"], r["seq"]) for r in found) == [("a", 1), ("b", 1), ("b", 2), ("b", 3)]


def test_retries_end_in_any_batches(spark, stream, tmp_path):
    schema = "item string, ts timestamp, attempt long, ok boolean"
    at = lambda s: BEGIN + timedelta(seconds=s)
    rows = [
        ("first", at(0), 1, True), ("first", at(30), 2, True),
        ("third", at(0), 1, False), ("third", at(30), 2, None), ("third", at(60), 3, True),
        ("never", at(0), 1, False), ("never", at(30), 2, False), ("never", at(60), 3, False), ("never", at(90), 4, True),
        ("silent", at(0), 1, False), ("silent", at(30), 2, False), ("silent", at(30 + K.ATTEMPT_TIMEOUT_S + K.BACKOFF_S + 1), 3, True),
        ("edge", at(0), 1, False), ("edge", at(K.ATTEMPT_TIMEOUT_S + K.BACKOFF_S), 2, True),
    ]
    want = [("edge", 2, 30, "done"), ("first", 1, 0, "done"), ("never", None, 60, "failed"), ("silent", None, 30, "silent"), ("third", 3, 60, "done")]
    for seed in (1, 2, 3):
        found = result(spark, attempts.first_success(stream([*shuffled(rows, seed), [("last", LAST, 1, True)]], schema), "item", "30 days"), tmp_path)
        assert sorted(tuple(r) for r in found) == want


def test_a_poll_that_never_hits_ends_by_its_timer(spark, stream, tmp_path):
    schema = "item string, ts timestamp, attempt long, hit boolean"
    at = lambda ms: BEGIN + timedelta(milliseconds=ms)
    rows = [("hit", at(2000 * k), k + 1, k == 7) for k in range(12)] + [("never", at(2000 * k), k + 1, False) for k in range(4)]
    rows += [("over", at(2000 * k), k + 1, k == 30) for k in range(31)] + [("late", at(0), 1, False), ("late", at(60_001), 2, True)]
    for seed in (1, 2):
        found = result(spark, attempts.poll_until(stream([*shuffled(rows, seed), [("last", LAST, 1, True)]], schema), "item", "30 days"), tmp_path)
        assert sorted((tuple(r) for r in found), key=lambda r: r[0]) == [("hit", 8, 14000), ("late", None, None), ("never", None, None), ("over", None, None)]


def test_transcripts_fold_as_in_batch(spark, stream, tmp_path):
    user = lambda text: json.dumps({"agentId": "a1", "type": "user", "message": {"role": "user", "content": text}})
    turn = lambda stop, kind, text: json.dumps({"type": "assistant", "message": {"role": "assistant", "stop_reason": stop, "content": [{"type": "text", "text": "x"}, {"type": kind, "text": text}]}})
    files = {
        "p/agent-1.jsonl": [user(f"[{K.ITEM_MARKER}: i1] do"), turn("tool_use", "tool_use", None), user("more"), turn("end_turn", "text", "done")],
        "p/agent-2.jsonl": [user("do it"), turn("tool_use", "text", "half")],
        "p/agent-3.jsonl": ["broken", "", "{"],
        "p/agent-4.jsonl": [turn("end_turn", "text", "all"), user(f"[{K.ITEM_MARKER}: i4]")],
        "p/agent-5.jsonl": [user("x")],
    }
    rows = [(path, BEGIN + timedelta(seconds=i), i, line) for path, lines in files.items() for i, line in enumerate(lines)]
    schema = "path string, ts timestamp, line_no long, value string"
    sidecars = spark.createDataFrame([("p/agent-2.jsonl", "second", None, True), ("p/agent-5.jsonl", None, "t5", False)], "path string, description string, tool_use_id string, stopped boolean")
    want = {tuple(r) for r in transcripts.fold(spark.createDataFrame(rows, schema), sidecars).collect() if r["reason"] != "unreadable"}
    assert len(want) == 4
    for seed in (1, 2):
        found = result(spark, stream_transcripts.fold(stream([*shuffled(rows, seed), [("last", LAST, 0, user("x"))]], schema), sidecars, "30 days"), tmp_path)
        assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_census_gate_of_streams(spark, stream, tmp_path):
    schema = "id string, ts timestamp"
    at = lambda m: BEGIN + timedelta(minutes=m)
    asked = [("in time", at(0)), ("at deadline", at(0)), ("too late", at(0)), ("never", at(5)), ("asked twice", at(1)), ("asked twice", at(2)), (None, at(3))]
    made = [("in time", at(30)), ("at deadline", at(60)), ("too late", at(61)), ("no one asked", at(10)), ("asked twice", at(20)), ("asked twice", at(20)), ("before", at(1))]
    asked.append(("before", at(2)))
    for seed in (1, 2):
        last = [[(f"last {n}", LAST + timedelta(days=n))] for n in range(2)]
        out = gate.census_gate(stream([*shuffled(asked, seed, 3), *last], schema), stream([*shuffled(made, seed, 4), *last], schema), "1 hour", "30 days")
        found = sorted((r["id"], r["class"]) for r in result(spark, out, tmp_path) if not r["id"].startswith("last"))
        assert found == sorted(
            [("in time", "matched"), ("at deadline", "matched"), ("too late", "missing"), ("too late", "extra"), ("never", "missing"), ("no one asked", "extra"), ("asked twice", "matched"), ("before", "missing"), ("before", "extra")]
        )


def test_the_gate_keeps_buckets_of_keys_not_rows(spark, stream, tmp_path):
    """Before, each row was several entries of three stateful operators. Repeats count once within the lateness."""
    at = lambda m: BEGIN + timedelta(minutes=m)
    asked = [[(i, at(i % 50)) for i in range(600)] + [(1000, at(0))], [(1000, at(50)), (2000, at(100))], [(5000, at(400))], [(6000, at(401))], [(1000, at(450)), (3000, at(401))]]
    made = [[(i, at(i % 50 + 60)) for i in range(0, 600, 2)], [(i, at(i % 50 + 5)) for i in range(1, 600, 4)] + [(4000, at(90))], [(5001, at(400))], [(6001, at(401))], [(1000, at(460)), (3000, at(462))]]
    last = [[(-1 - n, LAST + timedelta(days=n))] for n in range(2)]
    out = gate.census_gate(stream([*asked, *last], "id long, ts timestamp"), stream([*made, *last], "id long, ts timestamp"), "1 hour", "2 hours")
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "_bucket" in plan and "Join" not in plan
    want = [(i, "matched" if i % 2 == 0 or i % 4 == 1 else "missing") for i in range(600)]
    # 1000 comes again within the lateness (dropped) and hours later, when it is new.
    want += [(1000, "missing"), (1000, "matched"), (2000, "missing"), (3000, "missing"), (3000, "extra"), (4000, "extra")]
    want += [(5000, "missing"), (5001, "extra"), (6000, "missing"), (6001, "extra")]
    rows = [r for r in result(spark, out, tmp_path) if r["id"] >= 0]
    assert sorted((r["id"], r["class"]) for r in rows) == sorted(want)
    assert all((r["asked_at"] is None) == (r["class"] == "extra") and (r["made_at"] is None) == (r["class"] == "missing") for r in rows)


def test_repeats_within_the_watermark_are_dropped(spark, stream, tmp_path):
    schema = "event_id long, ts timestamp"
    at = lambda h: BEGIN + timedelta(hours=h)
    batches = [[(1, at(0)), (1, at(0)), (2, at(1))], [(1, at(1)), (3, at(1.5))], [(4, at(9))], [(2, at(1)), (5, at(9))], [(1, at(10)), (6, at(20))], [(7, at(30))]]
    found = result(spark, windows.deduplicated(stream(batches, schema)).select("event_id"), tmp_path)
    # 2 comes again behind the watermark, 1 once its first is forgotten.
    assert sorted(r["event_id"] for r in found) == [1, 1, 2, 3, 4, 5, 6, 7]


def test_scrolls_end_at_the_height_of_their_step(spark, stream, tmp_path):
    schema = "item string, ts timestamp, step long, height long"
    at = lambda s: BEGIN + timedelta(seconds=s)
    px = K.SCROLL_STEP_PX["text"]
    heights = {"short": [px], "grows": [px + 1, 2 * px + 1, 3 * px], "shrinks": [9 * px, 8 * px, 2 * px, px], "never": [9 * px] * 4, "unknown": [None, None]}
    rows = [(item, at(10 * k), k + 1, h) for item, hs in heights.items() for k, h in enumerate(hs)]
    found = result(spark, attempts.scroll_steps(stream([*shuffled(rows, 4), [("last", LAST, 1, 0)]], schema), "item", "30 days"), tmp_path)
    assert {r["item"]: r["steps"] for r in found} == {"short": 1, "grows": 3, "shrinks": 3, "never": None, "unknown": None}


def test_the_state_store_knows_buckets_of_keys(spark, stream, tmp_path):
    """Calls to the store are made by bucket; before, each of many keys was a group of its own."""
    schema = "item string, ts timestamp, attempt long, hit boolean"
    rows = [(f"k{i}", BEGIN + timedelta(seconds=i % 7 + j), j, j == i % 3) for i in range(400) for j in range(4)]
    out = attempts.poll_until(stream([*shuffled(rows, 6, 2), [("last", LAST, 1, True)]], schema), "item", "30 days")
    assert "TransformWithState" in (plan := out._jdf.queryExecution().analyzed().toString()) and "_bucket" in plan
    assert {r["item"]: r["attempt"] for r in result(spark, out, tmp_path)} == {f"k{i}": i % 3 + 1 for i in range(400)}
