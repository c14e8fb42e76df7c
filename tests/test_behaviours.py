"""Rules that results must keep, on small rows."""

import datetime
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import constants as K
from gleaner.functions import fences as N
from gleaner.functions import html as H
from gleaner.functions import sql as Q
from gleaner.functions import text as T
from gleaner.functions import urls as U
from gleaner.operators import circuit, commands, compose, fanout, linkstate, matching, media, ordering, quality, robots, scalars, transcripts
from gleaner.sources import readers, store
from gleaner.streaming import breaker as stream_breaker


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("value,empty", [(None, True), ("", True), ("-", True), (" N/A ", True), (" ", False), ("0", False), ("false", False)])
def test_white_space_is_filled_but_a_dash_is_not(spark, value, empty):
    assert one(spark, T.is_empty("v"), v=value) is empty


def test_echo_needs_two_weak_signs_or_one_strong(spark):
    assert one(spark, T.is_echo("v"), v="see https://x.org")
    assert one(spark, T.is_echo("v"), v="a%20b")
    assert not one(spark, T.is_echo("v"), v="100% of it")
    assert not one(spark, T.is_echo("v"), v="index.html")
    assert one(spark, T.is_echo("v"), v="a-very-long-name-of-a-page.html")
    assert not one(spark, T.is_echo("v"), v=None)


def test_number_norm_uses_floor_division_of_python(spark):
    r = random.Random(1)
    values = [r.uniform(-1e4, 1e4) for _ in range(200)] + [1.0, -0.3, 0.0, 12.5]
    rows = spark.createDataFrame([(repr(v),) for v in values], "v string")
    assert [x[0] for x in rows.select(T.number_norm("v", 0.1)).collect()] == [str(int(v // 0.1)) for v in values]
    assert one(spark, T.number_norm("v", 0.1), v=" Abc ") == "abc"


def test_titles_and_text(spark):
    html = "<TITLE lang=en> A &amp; B </TITLE><script>var a='<p>'</script><p>x y<br>z</p>"
    assert one(spark, H.title("h"), h=html) == "A &amp; B"
    assert one(spark, H.title_decoded("h"), h=html) == "A & B"
    assert one(spark, H.title("h"), h="<p>none") is None
    assert one(spark, H.visible_text("h"), h=html) == "A &amp; B x y z"
    assert one(spark, H.text_lines("h"), h="<p>x</p><div> </div>y<br/>z") == ["x", "y", "z"]
    assert one(spark, H.decode_entities("h"), h="&#65;&#x20AC;&lt;&bad;&amp;lt;&#0;") == "A€<&bad;&lt;\0"


def test_a_long_page_with_an_error_phrase_is_not_suspect(spark):
    rows = [(1, "<title>t</title>" + "word " * 900 + "access denied"), (2, "<title>t</title>access denied"), (3, "short"), (4, "<title>t</title>" + "word " * 200), (5, None)]
    found = quality.soft_errors(spark.createDataFrame(rows, "page_id long, html string"))
    assert {r["page_id"]: r["suspect"] for r in found.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}


def test_agreement_keeps_absence_apart(spark):
    a = spark.createDataFrame([(1, "X ", None), (2, "y", "1"), (3, "z", "")], "id long, p string, q string")
    b = spark.createDataFrame([(1, "x", "2"), (2, "other", "1"), (4, "w", None)], "id long, p string, q string")
    found = quality.agreement(a, b, "id", {"p": None, "q": None})
    got = {(r["id"], r["field"]): r["class"] for r in found.collect()}
    assert got == {(1, "p"): "agreed", (1, "q"): "only_in_b", (2, "p"): "disputed", (2, "q"): "agreed", (3, "p"): "only_in_a", (4, "p"): "only_in_b"}
    assert quality.agreement_rate(found).first()["rate"] == pytest.approx(2 / 3)
    assert quality.agreement_rate(found.where("false")).first()["rate"] == 1.0


def test_census_of_nothing_has_rate_zero(spark):
    found = quality.field_census(spark.createDataFrame([], "id long, a string"), ["a"])
    assert [(r["filled"], r["rate"]) for r in found.collect()] == [(0, 0.0)]


def test_last_record_of_a_key_wins(spark):
    rows = spark.createDataFrame([(1, 0, "old"), (1, 1, "new"), (2, 0, "x")], "id long, ordinal long, v string")
    assert {r["id"]: r["v"] for r in quality.last_wins(rows, "id", "ordinal").collect()} == {1: "new", 2: "x"}


def test_best_under_refuses_at_the_floor_and_takes_the_earlier_of_ties(spark):
    rows = [("a", 1, 5.0), ("b", 2, 3.0), ("b", 1, 3.0), ("b", 3, 9.0), ("c", 1, 1.0), ("d", 1, None), ("e", 1, float("nan")), ("e", 2, 2.0)]
    found = matching.best_under(spark.createDataFrame(rows, "q string, o int, d double"), "q", "d", "o", 5.0)
    got = {r["q"]: (r["o"], r["d"], r["runner_up"], r["margin"], r["skipped"]) for r in found.collect()}
    assert got == {"b": (1, 3.0, 3.0, 0.0, 0), "c": (1, 1.0, None, None, 0), "e": (2, 2.0, None, None, 1)}


def test_nearest_geo_misses_nothing_at_band_edges(spark):
    r = random.Random(2)
    points = [(i, 50 + r.random() * 0.1, 10 + r.random() * 0.1) for i in range(60)]
    places = [(i, 50 + r.random() * 0.1, 10 + r.random() * 0.1) for i in range(60)]
    p = spark.createDataFrame(points, "q long, lat double, lon double")
    c = spark.createDataFrame(places, "o long, lat double, lon double")
    d = matching.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    want = {(r["q"], r["o"]) for r in p.alias("a").crossJoin(c.alias("b")).where(d < 1500).select("q", "o").collect()}
    assert {(r["q"], r["o"]) for r in matching.near_pairs(p, c, "q", "o").collect()} == want
    assert want


def test_breaker_equals_a_loop(spark):
    from gleaner.streaming.breaker import NAMES, step

    r = random.Random(3)
    kinds = [None, None, "throttled", "unreachable"]
    rows = [(run, i, r.choice(kinds if run % 5 else [*kinds, "refused"])) for run in range(60) for i in range(40)]
    events = spark.createDataFrame(rows, "run long, seq long, kind string")
    want_trips, want_counts = {}, {}
    for run in range(60):
        counts, free = dict.fromkeys(NAMES, 0), dict.fromkeys(NAMES, 0)
        for _, i, kind in (x for x in rows if x[0] == run):
            step(free, kind)
            want_counts[run, i] = tuple(free[n] for n in NAMES)
            if run not in want_trips and step(counts, kind):
                want_trips[run] = (i, kind)
    got = circuit.counters(events, "run", ["seq"]).collect()
    assert {(x["run"], x["seq"]): tuple(x[f"n_{n}"] for n in NAMES) for x in got} == want_counts
    assert {x["run"]: (x["seq"], x["kind"]) for x in circuit.trips(events, "run", ["seq"]).collect()} == want_trips


@pytest.mark.parametrize(
    "text,path,allowed",
    [
        ("User-agent: *\nAllow: /\nDisallow: /private", "/private/x", False),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True),
        ("User-agent: *\nDisallow: /\n\nUser-agent: gleanbot\nDisallow: /x", "/y", True),
        ("User-agent: *\nDisallow: page=", "/list?page=2", False),
        ("User-agent: *\nDisallow: /*.pdf$", "/a.pdf?x", True),
        ("User-agent: *\nDisallow: /*.pdf$", "/a.pdf", False),
        ("User-agent: a\nUser-agent: gleanbot\nDisallow: /z", "/z", False),
        ("Disallow: /", "/", True),
        ("User-agent: *\nDisallow:", "/any", True),
        (None, "/any", False),
    ],
)
def test_robots(spark, text, path, allowed):
    files = spark.createDataFrame([("http://h", text)], "origin string, robots string")
    links = spark.createDataFrame([("http://h" + path, "http://h")], "url string, origin string")
    assert robots.allowed(links, files, "GleanBot/1").first()["allowed"] is allowed


def test_sitemap_walk_ends_on_cycles(spark):
    rows = [("a", True, 0, "b"), ("b", True, 0, "a"), ("b", True, 1, "c"), ("c", False, 0, "page")]
    entries = spark.createDataFrame(rows, "sitemap string, is_index boolean, pos int, loc string")
    found = robots.sitemap_walk(entries, spark.createDataFrame([("a",)], "s string"), 5)
    assert {(r["sitemap"], r["level"]) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_authorization_is_by_list_and_prefix_only(spark):
    replies = spark.createDataFrame([("abc123",), ("abc",), ("zzz",), ("",)], "agent_id string")
    wanted = spark.createDataFrame([("abc1",), ("",)], "w string")
    got = {r["agent_id"]: r["authorized"] for r in fanout.authorize(replies, wanted).collect()}
    assert got == {"abc123": True, "abc": True, "zzz": False, "": False}


def test_ledger_buckets_in_order(spark):
    def fenced(body, tag="json"):
        return f"```{tag}\n{body}\n```"

    rows = [
        ("bad", "i", fenced("{}")), ("a1", "i", "no fence"), ("a2", "i", fenced("{oops")), ("a3", None, fenced('{"t": 1}')),
        ("a4", "i", fenced('{"records": []}')), ("a5", "i", fenced('{"odd": 1}')), ("a6", "i", fenced('{"t": 0}')), ("a7", None, fenced('{"item_id": "own", "t": 1}')),
        ("a8", "i", fenced("a much longer block than the other", "") + "\n" + fenced('{"t": 2}')),
    ]
    replies = spark.createDataFrame([(a, i, a, t) for a, i, t in rows], "agent_id string, item_id string, source string, text string")
    wanted = spark.createDataFrame([("a",)], "w string")
    found = fanout.ledger(replies, wanted, schema_keys=["t", "records", "item_id"])
    got = {r["agent_id"]: r["bucket"] for r in found.collect()}
    assert got == {"bad": "unauthorized", "a1": "no-block", "a2": "unparseable", "a3": "unknown-key", "a4": "empty-result", "a5": "unknown-key", "a6": "applied", "a7": "applied", "a8": "applied"}
    kept = {r["item_id"]: r["agent_id"] for r in fanout.applied(found).collect()}
    assert kept == {"i": "a8", "own": "a7"}
    assert {r["bucket"]: r["n"] for r in fanout.reject_counts(found).collect()} == {"unauthorized": 1, "no-block": 1, "unparseable": 1, "unknown-key": 2, "empty-result": 1}


def test_marked_block_comes_before_a_larger_one(spark):
    text = "```\nlarge " + "x" * 50 + "\n```\n```\nmark\n```"
    assert one(spark, N.select_block("t", "mark"), t=text) == "mark"
    assert one(spark, N.select_block("t"), t=text).startswith("large")
    assert one(spark, N.self_report("t"), t="# Verification: 3 of 5 items. Excluded: a, b.")["excluded"] == ["a", "b"]
    assert one(spark, N.self_report("t"), t="verification: 3 of 5. excluded: none")["excluded"] == []
    assert one(spark, N.self_report("t"), t="nothing") is None


@pytest.mark.parametrize("n,status,stored,verdict", [(0, "ok", 3, "manual"), (5, "access_blocked", 5, "manual"), (5, "ok", 4, "ok"), (5, "ok", 3, "undercoverage"), (5, "ok", 9, "ok"), (5, "ok", None, "manual")])
def test_what_is_not_measured_is_unknown(spark, n, status, stored, verdict):
    row = spark.createDataFrame([(n, status, stored)], "n long, s string, k long")
    assert row.select(scalars.assess(F.col("s"), F.col("n"), F.col("k"))["verdict"]).first()[0] == verdict


def test_a_sticky_mark_on_a_dead_link_is_probed_again(spark):
    rows = [("a", 200, "fetch_js"), ("b", 404, "fetch_js"), ("c", 200, None)]
    states = spark.createDataFrame(rows, "url string, http_status int, verified_via string")
    probed = spark.createDataFrame([("a", 500), ("b", 200)], "url string, status int")
    got = {r["url"]: (r["status"], r["probed"]) for r in linkstate.resolve(states, probed).collect()}
    assert got == {"a": (200, False), "b": (200, True), "c": (K.NO_RESPONSE, True)}


def test_writers_own_their_columns(spark):
    states = spark.createDataFrame([("a", 200, "d1", {"x": "1", "y": "2"})], "url string, http_status int, last_checked string, verdicts map<string,string>")
    updates = spark.createDataFrame([("a", 404, "d2"), ("b", 200, "d2")], "url string, http_status int, last_checked string")
    got = {r["url"]: (r["http_status"], r["verdicts"]) for r in linkstate.merge_http(states, updates).collect()}
    assert got == {"a": (404, {"x": "1", "y": "2"}), "b": (200, None)}
    verdicts = spark.createDataFrame([("a", "x", "9")], "url string, kind string, verdict string")
    assert linkstate.merge_verdicts(states, verdicts).first()["verdicts"] == {"x": "9", "y": "2"}


def test_urls(spark):
    assert one(spark, U.host("u"), u="HTTP://u:p@Ex-Ample.com:80/x") == "ex-ample.com"
    assert one(spark, U.host("u"), u="http://[::1]:8/x") == "::1"
    assert one(spark, U.host("u"), u="/relative") == ""
    assert one(spark, U.timeout_s("u"), u="http://x/a.PDF?b") == K.PDF_TIMEOUT_S
    encoded = one(spark, U.encode_url("u"), u="http://bücher.example/a b/é?q=ñ&r=%20#ü")
    assert encoded == "http://xn--bcher-kva.example/a%20b/%C3%A9?q=%C3%B1&r=%20#%C3%BC"
    assert one(spark, U.encode_url("u"), u=encoded) == encoded
    assert tuple(one(spark, U.pin("u"), u="h:2001:db8::1")) == ("h", "[2001:db8::1]")


def test_jpeg_frames(spark):
    body = b"\xff\xd8" + b"x" * 20_000
    rows = [(0, body + b"\xff\xd9"), (1, body), (2, body + b"\xff\xd9log"), (3, b"\xff\xd8xx\xff\xd9"), (4, b""), (5, None), (6, b"GIF89a"), (7, body + b"\xff\xd9" + b"y" * 70_000)]
    frames = spark.createDataFrame(rows, "id int, data binary").select("id", media.jpeg_frame("data").alias("f"))
    got = {r["id"]: (r["f"]["state"], r["f"]["valid"], r["f"]["strict"]) for r in frames.collect()}
    assert got == {
        0: ("ok", True, True), 1: ("truncated (no EOI)", False, False), 2: ("ok (3b trailing after EOI)", True, False), 3: ("too small (6b)", False, True),
        4: ("empty", False, False), 5: ("empty", False, False), 6: ("not a jpeg", False, False), 7: ("truncated (no EOI)", False, False),
    }


def test_transcripts(spark):
    lines = [
        ("p/agent-1.jsonl", 0, '{"type": "user", "agentId": "a1", "message": {"role": "user", "content": "[gleaner-item: g/i1] go"}}'),
        ("p/agent-1.jsonl", 1, '{"type": "assistant", "message": {"stop_reason": "end_turn", "content": [{"type": "text", "text": "done"}]}}'),
        ("p/agent-2.jsonl", 0, '{"type": "assistant", "message": {"stop_reason": "tool_use", "content": [{"type": "tool_use"}]}}'),
        ("p/agent-3.jsonl", 0, '{"torn'), ("p/agent-4.jsonl", 0, '{"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "hi"}]}}'),
    ]
    cars = [("p/agent-2.jsonl", "described", "t", True), ("p/agent-4.jsonl", None, "tool", False)]
    found = transcripts.fold(spark.createDataFrame(lines, "path string, line_no long, value string"), spark.createDataFrame(cars, "path string, description string, tool_use_id string, stopped boolean"))
    got = {r["path"][8]: (r["agent_id"], r["target"], r["identified_by"], r["text"], r["reason"]) for r in found.collect()}
    assert got == {
        "1": ("a1", "g/i1", "marker", "done", "ok"), "2": ("2", "described", "description", None, "stopped-by-user"),
        "3": ("3", None, None, None, "unreadable"), "4": ("4", "tool", "tool_use_id", None, "no-assistant"),
    }


def test_templates_refuse_what_is_missing(spark):
    filled = lambda t, **v: one(spark, compose.fill("t", {k: F.lit(x).cast("string") for k, x in v.items()}), t=t)
    assert filled("a {{x}}", x="1")["text"] == "a 1"
    assert filled("a {{x}}", x=None)["error"] == "null: x"
    assert filled("a {{x}} {{y}}", x="1")["error"] == "unknown: y"
    assert filled("a {{x}", x="1")["error"] == "unfilled"


def test_lines_and_store(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text('["a", {"id": "b", "url": "u"}]')
    items = readers.worklist(readers.json_records(spark, str(tmp_path / "r")))
    assert [(r["ordinal"], r["id"], r["url"]) for r in items.orderBy("ordinal").collect()] == [(0, "a", None), (1, "b", "u")]
    (tmp_path / "p" / "s" / "subagents").mkdir(parents=True)
    (tmp_path / "p" / "s" / "subagents" / "agent-7.jsonl").write_text('{"a": 1}\n\n{"b')
    (tmp_path / "p" / "s" / "subagents" / "agent-7.meta.json").write_text('{"description": "d", "stoppedByUser": true}')
    assert readers.transcripts(spark, str(tmp_path / "p")).count() == 3
    car = readers.sidecars(spark, str(tmp_path / "p")).first()
    assert car["path"].endswith("agent-7.jsonl") and car["description"] == "d" and car["stopped"]
    replies = readers.replies(spark, str(tmp_path / "r"))
    assert [(r["agent_id"], r["item_id"]) for r in replies.collect()] == [("x", None)]
    raw = spark.createDataFrame([("1", "<title>t</title>"), ("2", "none")], "id string, body string")
    parsed = store.parse(raw, H.title("body"))
    assert [r["id"] for r in store.pending(raw.select("id"), parsed).collect()] == ["2"]


def test_order_and_exit_codes(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [r["v"] + 1 for r in ordering.ordered(rows, "v").orderBy("place").collect()] == list(range(1, 1001))
    assert commands.qa_exit(rows.where("v < 0")).first()["exit_code"] == 0
    assert commands.qa_exit(rows).first()["exit_code"] == 1


def test_sql_functions_are_inlined(spark):
    Q.register(spark)
    plan = spark.range(3).selectExpr("is_empty_value(cast(id as string)) as e")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_flagship_has_no_python(spark):
    from gleaner.plans import registry

    for name in ("soft_error_by_host", "field_census", "agree_compare", "breaker"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(
    "raw,shown",
    [
        ("&#128512;&#x1F600;", "\U0001f600\U0001f600"),
        ("&#65533; &#xFFFD; &#0000065;", "\ufffd \ufffd A"),
        ("&#38;amp; &amp;lt;", "&amp; &lt;"),
        ("a\x01b &AMP; &bogus; &; &#x; &#1114112; &#99999999999;", "a\x01b & &bogus; &; &#x; &#1114112; &#99999999999;"),
        ("&#xD800;", "\ufffd"),
        ("plain", "plain"),
        (None, None),
    ],
)
def test_character_references_are_decoded_once(spark, raw, shown):
    assert one(spark, H.decode_entities("v"), v=raw) == shown


def test_lines_and_attributes_are_decoded(spark):
    page = '<p>a &amp; b&nbsp;</p><script x>no</script><a href="">e</a><a data-href="d" HREF=\'/q?a&amp;b\'>l</a>'
    assert one(spark, H.text_lines("v"), v=page) == ["a & b", "e l"]
    assert one(spark, H.attributes("v", "a", "href"), v=page) == ["d"]
    assert one(spark, H.attributes("v", "a", "href"), v=page.replace("data-href", "data-x")) == ["/q?a&b"]
    assert one(spark, H.slice_between("v", r"b\d", r"e\d", pattern=True), v="a b1 c e2 d") == "b1 c "
    assert one(spark, H.slice_between("v", "B1"), v="a b1 c") == "b1 c"
    assert one(spark, H.slice_between("v", "(x", "+"), v="1 (X 2 + 3") == "(X 2 "


def test_hires_takes_ids_as_they_are(spark):
    assert one(spark, U.hires(F.col("v"), F.lit("a$1\\\\b"), 9), v="/{id}/{w}/{id}") == "/a$1\\\\b/9/{id}"


def test_fixed_values_by_name():
    assert K.get("BATCH_SIZE") == K.BATCH_SIZE and K.get("no.such", 3) == 3
    assert K.get("LOCALES.en.challenge_markers") == K.LOCALES["en"]["challenge_markers"]
    with pytest.raises(KeyError):
        K.get("BATCH_SIZES")


def test_sitemap_walk_goes_on_until_nothing_is_new_and_lists_what_a_limit_left(spark):
    chain = [(f"m{i:02d}", True, 0, f"m{i + 1:02d}") for i in range(13)] + [("m00", True, 1, "side"), ("side", True, 0, "m00")]
    entries = spark.createDataFrame(chain, "sitemap string, is_index boolean, pos int, loc string")
    roots = spark.createDataFrame([("m00",)], "sitemap string")
    found = {r["sitemap"]: r["level"] for r in robots.sitemap_walk(entries, roots).collect()}
    assert found == {**{f"m{i:02d}": i for i in range(14)}, "side": 1}
    limited = {r["sitemap"]: r["fetched"] for r in robots.sitemap_walk(entries, roots, 3).collect()}
    assert limited == {"m00": True, "m01": True, "side": True, "m02": False}


def test_runner_up_is_sought_beyond_the_floor(spark):
    points = spark.createDataFrame([(1, 50.0, 10.0), (2, -60.0, 100.0), (3, 89.999, 0.0)], "q int, lat double, lon double")
    places = spark.createDataFrame([(7, 50.001, 10.0), (8, 50.1, 10.0), (9, 89.999, 180.0), (10, None, 1.0)], "o int, lat double, lon double")
    found = {r["q"]: r for r in matching.nearest_geo(points, places, "q", "o").collect()}
    assert set(found) == {1, 3} and found[1]["o"] == 7 and found[3]["o"] == 9
    assert 11_000 < found[1]["runner_up"] < 11_200 and found[3]["runner_up"] > 4_000_000 and found[1]["skipped"] == 1
    alone = matching.nearest_geo(points, places.where("o = 7"), "q", "o").collect()
    assert [(r["q"], r["runner_up"], r["margin"]) for r in alone] == [(1, None, None)]


@pytest.mark.parametrize("spread", [0.02, 3.0, 60.0])
def test_nearest_geo_equals_a_loop(spark, spread):
    """Clusters of several densities, far ones, the poles, the date line, repeated places and one alone."""
    import math

    r = random.Random(int(spread))
    place = lambda lat, lon: (max(-90.0, min(90.0, r.gauss(lat, spread))), (r.gauss(lon, spread) + 180) % 360 - 180)
    centres = [(0.0, 0.0), (89.9, 10.0), (-20.0, 179.99), (45.0, 90.0), (1e-6, -1e-6)]
    places = [(i, *place(*centres[i % 5])) for i in range(120)] + [(120, 0.0, 0.0), (121, 0.0, 0.0), (122, -89.0, 0.0), (123, None, 1.0)]
    points = [(i, lat + r.uniform(-0.005, 0.005) if abs(lat) < 89 else lat, lon) for i, lat, lon in places[:100]] + [(200, 0.0, 0.0), (201, -89.0, 0.005), (202, 30.0, -100.0)]

    def apart(a, b):
        x, y = math.radians(a[1]), math.radians(b[1])
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin((math.radians(b[2]) - math.radians(a[2])) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1.0, math.sqrt(h)))

    want = {}
    for p in points:
        first, second = sorted((apart(p, c), c[0]) for c in places if c[1] is not None)[:2]
        if first[0] < 1500:
            want[p[0]] = (first[1], round(first[0], 3), round(second[0], 3))
    found = matching.nearest_geo(spark.createDataFrame(points, "q int, lat double, lon double"), spark.createDataFrame(places, "o int, lat double, lon double"), "q", "o").collect()
    assert {x["q"]: (x["o"], round(x["distance"], 3), round(x["runner_up"], 3)) for x in found} == want
    assert len(want) > 20 and all(x["skipped"] == 1 for x in found)


@pytest.mark.parametrize("hot_pairs", [matching.HOT_PAIRS, 250, 20])
def test_best_label_equals_a_loop_over_all_candidates(spark, monkeypatch, hot_pairs):
    """Also where tokens of many queries or labels are left to the bounds."""
    monkeypatch.setattr(matching, "HOT_PAIRS", hot_pairs)
    r = random.Random(8)
    words = ["".join(r.choice("abcdef") for _ in range(4)) for _ in range(40)] + ["common"]
    text = lambda n: " ".join(["common"] * r.randint(0, 1) + [r.choice(words) for _ in range(r.randint(0, n))])
    queries, labels = [(i, text(30)) for i in range(60)], [(i, text(8)) for i in range(25)]
    q, c = spark.createDataFrame(queries, "q int, t string"), spark.createDataFrame(labels, "o int, l string")
    for floor in (0.05, 0.4, 0.7):
        want = {}
        for i, t in queries:
            scored = sorted((1 - (len(set(t.split()) & set(x.split())) / min(len(set(t.split())), len(set(x.split()))) if t and x else 0.0), o) for o, x in labels)
            if scored[0][0] < 1 - floor:
                want[i] = (scored[0][1], round(scored[0][0], 9), round(scored[1][0], 9))
        found = matching.best_label(q, c, "q", "t", "o", "l", floor).collect()
        assert {r["q"]: (r["o"], round(r["distance"], 9), round(r["runner_up"], 9)) for r in found} == want


def test_sessions_equal_a_loop(spark):
    from gleaner.plans import registry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    events = sorted((r["user_id"], r["ts"]) for r in spark.read.parquet(f"{folder}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts")).collect())
    last = max(ts for _, ts in events)
    want, gap = [], datetime.timedelta(minutes=30)
    for user, ts in events:
        if want and want[-1][0] == user and ts < want[-1][2]:
            want[-1][2:] = [max(want[-1][2], ts + gap), want[-1][3] + 1]
        else:
            want.append([user, ts, ts + gap, 1])
    closed = [tuple(w) for w in want if w[2] <= last - datetime.timedelta(hours=2)]
    found = [tuple(r) for r in registry.QUERIES["stream_sessions"](spark, folder).select("user_id", "starts", "ends", "n").collect()]
    assert sorted(found) == sorted(closed)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        store.shared_folder(Session())


def test_many_rows_at_few_places_are_compared_by_place(spark):
    place = lambda i: (50.0 + i % 5 * 0.01, 10.0 + i % 3 * 0.01)
    points = spark.createDataFrame([(i, *place(i)) for i in range(3000)] + [(3000, *place(1)), (3000, *place(7)), (3001, None, 1.0)], "q int, lat double, lon double")
    places = spark.createDataFrame([(i, *place(i + 1)) for i in range(3000)] + [(4000, 51.0, 10.0)], "o int, lat double, lon double")
    assert matching._at_places(places, "o").count() == 31
    found = {r["q"]: (r["o"], r["distance"], r["runner_up"]) for r in matching.nearest_geo(points, places, "q", "o").collect()}
    assert found == {i: ((i - 1) % 15, 0.0, 0.0) for i in range(3000)} | {3000: (0, 0.0, 0.0)}
    thin = {r["q"]: (r["o"], r["distance"] == 0, r["runner_up"] > 0) for r in matching.nearest_geo(points, places.where("o in (0, 4000)"), "q", "o").collect() if r["q"] % 15 == 1 or r["q"] == 3000}
    assert thin == {q: (0, True, True) for q in [*range(1, 3000, 15), 3000]}


def test_a_run_as_long_as_the_table_is_counted_in_ranges(spark):
    r = random.Random(3)
    rows = [(run, i, r.choice([None, None, "throttled", "unreachable", "refused"] if run else [None, "throttled", "unreachable"])) for run, n in ((0, 5000), (1, 40), (2, 1)) for i in range(n)]
    want, state = [], {}
    for run, i, kind in rows:
        counts = state.setdefault(run, dict.fromkeys(("refused", "throttled", "unreachable"), 0))
        stream_breaker.step(counts, kind)
        want.append((run, i, counts["refused"], counts["throttled"], counts["unreachable"]))
    r.shuffle(rows)
    found = circuit.counters(spark.createDataFrame(rows, "run int, at int, kind string"), "run", ["at"])
    assert sorted(tuple(x) for x in found.select("run", "at", "n_refused", "n_throttled", "n_unreachable").collect()) == want
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and all("_range#" in x or "_nr#" in x for x in dealt)  # before, all events of a run met in one task


def test_end_markers_count_within_the_tail_only(spark):
    cases = [b"\xff\xd8" + b"x" * 20_000 + b"\xff\xd9" + b"y" * n for n in (K.JPEG_TAIL - 3, K.JPEG_TAIL - 2, K.JPEG_TAIL - 1)]
    cases += [b"\xff\xd8\xff\xd9\xff\xd9\xd9\xff", b"\xff\xd9", b"\xff", bytes(range(256)) * 300, b"\xff\xd8" + b"\x00" * 9998 + b"\xff\xd9\xff"]
    frames = spark.createDataFrame(list(enumerate(cases)), "id int, data binary").select("id", media.jpeg_frame("data").alias("f"))
    assert "Python" not in frames._jdf.queryExecution().executedPlan().toString()  # no batch of buffers in a Python worker
    for x in frames.collect():
        raw = cases[x["id"]]
        at = raw.rfind(b"\xff\xd9")
        at = at if at >= len(raw) - K.JPEG_TAIL else -1
        assert (x["f"]["size"], x["f"]["end_at"], x["f"]["starts"], x["f"]["strict"]) == (len(raw), at, len(raw) > 3 and raw[:2] == b"\xff\xd8", raw[:2] == b"\xff\xd8" and raw[-2:] == b"\xff\xd9")
