"""Queries on work-lists, replies, transcripts, prompts and call plans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import fences as N
from ..operators import commands
from ..operators import compose as C
from ..operators import fanout as O
from ..operators import transcripts as R
from ..operators import workflows as W
from ..operators.ordering import ordered
from ..sources import readers as S
from ..sources import store, versions
from .base import DERIVED, query

#: What was asked for, what came back, and all there is.
DERIVED["worklist"] = "SELECT CAST(p_partkey AS STRING) AS id, p_partkey AS ordinal, p_name AS title FROM part WHERE p_partkey % 4 <> 0"
DERIVED["produced"] = "SELECT CAST(p_partkey AS STRING) AS id, p_brand AS brand FROM part WHERE p_partkey % 3 <> 0"
DERIVED["universe"] = "SELECT CAST(p_partkey AS STRING) AS id FROM part"
DERIVED["done"] = """
    SELECT CAST(p_partkey AS STRING) AS id, CASE p_partkey % 7 WHEN 0 THEN '"ok"' WHEN 1 THEN '{"status": "ok"}' WHEN 2 THEN '{"status": "bad"}' WHEN 3 THEN 'true' WHEN 4 THEN 'false' WHEN 5 THEN '"error"' ELSE '0' END AS state
    FROM part WHERE p_partkey % 5 <> 0"""

#: Replies of agents, whole and broken in every way.
DERIVED["replies"] = """
    SELECT 'agent-' || CAST(conv_id AS STRING) || 'x' || CAST(turn AS STRING) AS agent_id,
        CASE WHEN conv_id % 11 = 0 THEN NULL ELSE CAST(conv_id % 50 AS STRING) END AS item_id,
        'f' || lpad(CAST(conv_id AS STRING), 9, '0') || '-' || CAST(turn AS STRING) AS source,
        CASE WHEN (conv_id + turn) % 9 = 0 THEN text
            WHEN (conv_id + turn) % 9 = 1 THEN text || chr(10) || '```json' || chr(10) || '{"title": ' || chr(10) || '```'
            WHEN (conv_id + turn) % 9 = 2 THEN '```' || chr(10) || '{"records": []}' || chr(10) || '```'
            WHEN (conv_id + turn) % 9 = 3 THEN '```json' || chr(10) || '{"title": "", "note": null}' || chr(10) || '```'
            WHEN (conv_id + turn) % 9 = 4 THEN '```json' || chr(10) || '{"title": "a", "extra": 1}' || chr(10) || '```'
            WHEN (conv_id + turn) % 9 = 5 THEN '```text' || chr(10) || 'a longer block that is quoted first of all here' || chr(10) || '```' || chr(10) || '```JSON' || chr(10) || '{"title": "b"}' || chr(10) || '```' || chr(10) || 'Verification: ' || CAST(turn AS STRING) || ' of 12 items. Excluded: x, y z.'
            ELSE '```json' || chr(10) || '{"item_id": "own", "title": "c' || CAST(conv_id AS STRING) || '"}' || chr(10) || '```' END AS text
    FROM conversations"""
DERIVED["dispatched"] = "SELECT DISTINCT CASE WHEN conv_id % 2 = 0 THEN 'agent-' || CAST(conv_id AS STRING) || 'x' ELSE 'agent-' || CAST(conv_id AS STRING) || 'x0-and-more' END AS wanted FROM conversations WHERE conv_id % 3 <> 0"


@query("census_gate", """
    SELECT coalesce(w.id, p.id) AS id, CASE WHEN w.id IS NULL THEN 'extra' WHEN p.id IS NULL THEN 'missing' ELSE 'matched' END AS class FROM worklist w FULL JOIN produced p ON w.id = p.id
    UNION ALL SELECT id, 'invisible' FROM universe WHERE id NOT IN (SELECT id FROM worklist)""")
def _(t):
    return O.census_gate(t("worklist"), t("produced"), t("universe"))


@query("census_rollup", """
    SELECT (SELECT count(*) FROM worklist WHERE id IN (SELECT id FROM produced)) AS matched, (SELECT count(*) FROM worklist WHERE id NOT IN (SELECT id FROM produced)) AS missing,
        (SELECT count(*) FROM produced WHERE id NOT IN (SELECT id FROM worklist)) AS extra, (SELECT count(*) FROM universe WHERE id NOT IN (SELECT id FROM worklist)) AS invisible, false AS ok""")
def _(t):
    return O.census_rollup(O.census_gate(t("worklist"), t("produced"), t("universe")))


@query("strict_join", "SELECT id, brand FROM produced WHERE id IN (SELECT id FROM worklist)")
def _(t):
    return O.strict_join(t("worklist"), t("produced"))


_APPLIED = """
    SELECT (SELECT count(*) FROM produced WHERE id IN (SELECT id FROM worklist)) AS written, (SELECT count(*) FROM worklist WHERE id NOT IN (SELECT id FROM produced)) AS missing,
        (SELECT count(*) FROM produced WHERE id NOT IN (SELECT id FROM worklist)) AS extra, false AS ok"""


def _applied(t, dry_run: bool):
    path = f"{store.shared_folder(t.spark)}/applied-{uuid.uuid4().hex}"
    return store.write_applied(t("produced"), t("worklist"), path, dry_run), path


@query("snk_apply", f"SELECT a.*, p.id, p.brand FROM ({_APPLIED}) a, (SELECT id, brand FROM produced WHERE id IN (SELECT id FROM worklist)) p")
def _(t):
    """The records that were asked for, written and read back, with the census that the write took."""
    found, path = _applied(t, False)
    numbers = [F.lit(found[c]).alias(c) for c in ("written", "missing", "extra")]
    return versions.read(t.spark, path, "id string, brand string").select(*(c.cast("long").alias(n) for c, n in zip(numbers, ("written", "missing", "extra"), strict=True)), F.lit(found["ok"]).alias("ok"), "id", "brand")


@query("snk_apply_dry_run", f"SELECT a.*, 0 AS versions FROM ({_APPLIED}) a")
def _(t):
    """The same census without a write: nothing is there afterwards."""
    found, path = _applied(t, True)
    return versions.manifest(t.spark, path).agg(F.count(F.lit(1)).alias("versions")).select(*(F.lit(found[c]).cast("long").alias(c) for c in ("written", "missing", "extra")), F.lit(found["ok"]).alias("ok"), "versions")


@query("invisible", "SELECT id FROM universe WHERE id NOT IN (SELECT id FROM produced)")
def _(t):
    return t("universe").join(t("produced").select("id"), "id", "left_anti")


@query("set_missing", "SELECT id FROM worklist EXCEPT SELECT id FROM produced")
def _(t):
    return t("worklist").select("id").subtract(t("produced").select("id"))


@query("set_extra", "SELECT id FROM produced EXCEPT SELECT id FROM worklist")
def _(t):
    return t("produced").select("id").subtract(t("worklist").select("id"))


@query("set_matched", "SELECT id FROM produced INTERSECT SELECT id FROM worklist")
def _(t):
    return t("produced").select("id").intersect(t("worklist").select("id"))


@query("set_universe", "SELECT id FROM universe EXCEPT SELECT id FROM worklist")
def _(t):
    return t("universe").subtract(t("worklist").select("id"))


@query("set_union_keys", "SELECT id, min(o) AS ordinal FROM (SELECT id, ordinal AS o FROM worklist UNION ALL SELECT id, 1000000000 FROM produced) GROUP BY id")
def _(t):
    both = t("worklist").select("id", "ordinal").union(t("produced").select("id", F.lit(1_000_000_000).cast("long")))
    return both.groupBy("id").agg(F.min("ordinal").alias("ordinal"))


@query("set_union_results", "SELECT id FROM worklist UNION ALL SELECT id FROM produced")
def _(t):
    return t("worklist").select("id").unionByName(t("produced").select("id"))


@query("sorted_ids", "SELECT id, row_number() OVER (ORDER BY id) AS place FROM (SELECT DISTINCT id FROM produced)")
def _(t):
    return ordered(t("produced").select("id").distinct(), "id")


_FINISHED = "CASE WHEN state LIKE '{%' THEN state = '{\"status\": \"ok\"}' WHEN state LIKE '\"%' THEN state = '\"ok\"' ELSE state NOT IN ('false', '0') END"


@query("done_state", f"SELECT id, {_FINISHED} AS finished FROM done")
def _(t):
    return t("done").select("id", O.finished("state").alias("finished"))


@query("select_pending", f"SELECT id FROM worklist WHERE id NOT IN (SELECT id FROM done WHERE {_FINISHED})")
def _(t):
    return O.pending(t("worklist"), t("done")).select("id")


@query("src_done_map", f"SELECT count(*) AS entries, count(*) FILTER ({_FINISHED}) AS finished FROM done")
def _(t):
    return t("done").agg(F.count(F.lit(1)).alias("entries"), F.count_if(O.finished("state")).alias("finished"))


@query("batches", "SELECT ordinal // 32 AS batch, count(*) AS n FROM worklist GROUP BY 1")
def _(t):
    return O.batches(t("worklist")).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query(
    "worklist_lookup",
    """WITH items AS (SELECT id, ordinal, title FROM worklist UNION ALL SELECT id, ordinal + 1000000, 'again ' || title FROM worklist WHERE ordinal % 5 = 1),
       last AS (SELECT id, arg_max(title, ordinal) AS title FROM items GROUP BY id)
       SELECT u.id, l.title, (SELECT count(*) FROM items) AS items, (SELECT count(DISTINCT id) FROM items) AS keys FROM universe u LEFT JOIN last l ON l.id = u.id""",
)
def _(t):
    """Ids are looked up in a work-list that repeats some; repeats count in its length, not in its keys."""
    again = t("worklist").where("ordinal % 5 = 1").select("id", F.expr("ordinal + 1000000").alias("ordinal"), F.concat(F.lit("again "), "title").alias("title"))
    items = t("worklist").union(again)
    return O.lookup(items, t("universe")).select("id", "title").crossJoin(O.worklist_size(items))


_AUTH = """auth AS (SELECT r.*, EXISTS (SELECT 1 FROM dispatched a WHERE starts_with(r.agent_id, a.wanted) OR starts_with(a.wanted, r.agent_id)) AS authorized FROM replies r)"""


@query("authorize", f"WITH {_AUTH} SELECT source, agent_id, authorized FROM auth")
def _(t):
    return O.authorize(t("replies"), t("dispatched")).select("source", "agent_id", "authorized")


_FENCE = r"(?s)```([\w+-]*)[ \t]*\n(.*?)\n[ \t]*```"
_BLOCKS = f"""blocks AS (SELECT source, text, list_zip(list_transform(regexp_extract_all(text, '{_FENCE}', 1), lambda x: lower(x)), regexp_extract_all(text, '{_FENCE}', 2)) AS b FROM replies),
    bodies AS (SELECT source, text, b,
        list_sort(list_transform(list_filter(b, lambda x: x[1] = 'json'), lambda x: struct_pack(n := -length(x[2]), body := x[2])))[1].body AS tagged,
        list_sort(list_transform(b, lambda x: struct_pack(n := -length(x[2]), body := x[2])))[1].body AS plain FROM blocks),
    found AS (SELECT source, text, b, coalesce(tagged, plain) AS payload FROM bodies)"""


@query("fence_blocks", f"WITH {_BLOCKS} SELECT source, len(b) AS n_blocks, array_to_string(list_transform(b, lambda x: x[1]), ',') AS languages FROM found")
def _(t):
    b = N.blocks("text")
    return t("replies").select("source", F.size(b).cast("long").alias("n_blocks"), F.array_join(F.transform(b, lambda x: x["language"]), ",").alias("languages"))


@query("fence_select", f"WITH {_BLOCKS} SELECT source, plain AS body FROM bodies")
def _(t):
    return t("replies").select("source", N.select_block("text").alias("body"))


@query("fence_json", f"WITH {_BLOCKS} SELECT source, payload, CASE WHEN payload IS NULL THEN 'no-block' WHEN NOT json_valid(payload) THEN 'unparseable' ELSE 'ok' END AS status FROM found")
def _(t):
    return t("replies").select("source", N.json_block("text").alias("payload"), N.json_status("text").alias("status"))


@query("by_marker_size", f"WITH {_BLOCKS} SELECT source, coalesce(list_sort(list_transform(list_filter(b, lambda x: contains(x[2], 'quoted')), lambda x: struct_pack(n := -length(x[2]), body := x[2])))[1].body, plain) AS body FROM bodies")
def _(t):
    return t("replies").select("source", N.select_block("text", "quoted").alias("body"))


@query("self_report", r"SELECT source, CASE WHEN regexp_matches(text, '(?i)verification:\s*\d+\s+of\s+\d+') THEN CAST(regexp_extract(text, '(?i)verification:\s*(\d+)\s+of\s+(\d+)', 1) AS BIGINT) END AS n, CASE WHEN regexp_matches(text, '(?i)verification:\s*\d+\s+of\s+\d+') THEN 'x|y z' END AS excluded FROM replies")
def _(t):
    r = N.self_report("text")
    return t("replies").select("source", r["n"].alias("n"), F.array_join(r["excluded"], "|").alias("excluded"))


@query("strip_self_report", r"SELECT source, length(CASE WHEN regexp_matches(text, '(?i)verification:\s*\d+\s+of\s+\d+') THEN trim(regexp_replace(text, '(?i)[^\n]*verification:[^\n]*', ''), chr(10)) ELSE text END) AS chars FROM replies")
def _(t):
    return t("replies").select("source", F.length(N.strip_self_report("text")).cast("long").alias("chars"))


_LEDGER = f"""{_AUTH}, {_BLOCKS},
    named AS (SELECT a.source, a.agent_id, a.authorized, f.payload, json_valid(coalesce(f.payload, 'x')) AS good, a.text,
        coalesce(a.item_id, CASE WHEN json_valid(coalesce(f.payload, 'x')) THEN json_extract_string(f.payload, '$.item_id') END) AS item_id FROM auth a JOIN found f USING (source)),
    ledger AS (SELECT source, agent_id, item_id, payload, text, CASE WHEN NOT authorized THEN 'unauthorized' WHEN payload IS NULL THEN 'no-block' WHEN NOT good THEN 'unparseable' WHEN item_id IS NULL THEN 'unknown-key'
        WHEN payload IN ('{{"records": []}}', '{{"title": "", "note": null}}') THEN 'empty-result' WHEN contains(payload, '"extra"') THEN 'unknown-key' ELSE 'applied' END AS bucket FROM named)"""


def _ledger(t):
    return O.ledger(t("replies"), t("dispatched"), schema_keys=["item_id", "title", "note", "records"])


@query("ingest", f"WITH {_LEDGER} SELECT source, agent_id, item_id, bucket FROM ledger")
def _(t):
    return _ledger(t).select("source", "agent_id", "item_id", "bucket")


@query("ingest_applied", f"WITH {_LEDGER} SELECT item_id, max(source) AS source, arg_max(payload, source) AS payload FROM ledger WHERE bucket = 'applied' GROUP BY 1")
def _(t):
    return O.applied(_ledger(t)).select("item_id", "source", "payload")


@query("reject_counts", f"WITH {_LEDGER} SELECT b.bucket, count(l.bucket) AS n FROM (VALUES ('unauthorized'), ('no-block'), ('unparseable'), ('unknown-key'), ('empty-result')) b(bucket) LEFT JOIN ledger l ON l.bucket = b.bucket GROUP BY 1")
def _(t):
    return O.reject_counts(_ledger(t))


@query("top5_rejects", f"WITH {_LEDGER} SELECT bucket, source, row_number() OVER (PARTITION BY bucket ORDER BY source) AS place FROM ledger WHERE bucket <> 'applied' QUALIFY place <= 5")
def _(t):
    """The first five of each bucket: a partial aggregation keeps five per task."""
    from ..operators.matching import top_by

    return top_by(_ledger(t).where("bucket <> 'applied'"), "bucket", [F.col("source")], 5).select("bucket", "source", F.col("place").cast("long").alias("place"))


@query("payload_empty", f"WITH {_BLOCKS} SELECT source, coalesce(payload, '') IN ('', '{{\"records\": []}}', '{{\"title\": \"\", \"note\": null}}') AS hollow FROM found WHERE json_valid(coalesce(payload, 'null'))")
def _(t):
    rows = t("replies").select("source", N.json_block("text").alias("payload"), N.json_status("text").alias("status"))
    return rows.where("status <> 'unparseable'").select("source", O.empty_payload("payload").alias("hollow"))


@query("unknown_keys", f"WITH {_BLOCKS} SELECT source, array_to_string(list_filter(json_keys(payload), lambda k: k NOT IN ('item_id', 'title')), ',') AS unknown FROM found WHERE json_valid(coalesce(payload, 'x'))")
def _(t):
    rows = t("replies").select("source", N.json_block("text").alias("p")).where(F.try_parse_json("p").isNotNull())
    return rows.select("source", F.array_join(F.array_except(F.json_object_keys("p"), F.array(F.lit("item_id"), F.lit("title"))), ",").alias("unknown"))


@query("set_keys_closed", f"WITH {_BLOCKS} SELECT source, len(list_filter(json_keys(payload), lambda k: k NOT IN ('item_id', 'title', 'note', 'records'))) = 0 AS closed FROM found WHERE json_valid(coalesce(payload, 'x'))")
def _(t):
    rows = t("replies").select("source", N.json_block("text").alias("p")).where(F.try_parse_json("p").isNotNull())
    allowed = F.array(*map(F.lit, ("item_id", "title", "note", "records")))
    return rows.select("source", (F.size(F.array_except(F.json_object_keys("p"), allowed)) == 0).alias("closed"))


@query("keymap_lookup", "SELECT source, item_id, CASE WHEN CAST(item_id AS BIGINT) % 2 = 0 THEN 'target-' || item_id END AS target, CASE WHEN item_id IS NULL OR CAST(item_id AS BIGINT) % 2 > 0 THEN 'unknown-key' END AS reason FROM replies")
def _(t):
    rows = t("replies")
    keymap = rows.where("cast(item_id as long) % 2 = 0").select("item_id", F.concat(F.lit("target-"), "item_id").alias("target")).distinct()
    return O.mapped(rows, keymap).select("source", "item_id", "target", "reason")


@query("index_map", "SELECT source, coalesce(CASE WHEN length(agent_id) % 2 = 0 THEN 'known-' || agent_id END, agent_id) AS agent FROM replies")
def _(t):
    rows = t("replies")
    index = rows.where("length(agent_id) % 2 = 0").select("agent_id", F.concat(F.lit("known-"), "agent_id").alias("known")).distinct()
    return S.indexed(rows, "agent_id", index, "agent").select("source", "agent")


@query("normalize", "SELECT id, 'brand' AS field, CASE WHEN brand = 'Brand#1' THEN 'first' ELSE brand END AS value, brand = 'Brand#1' AS changed FROM produced WHERE brand <> 'Brand#2'")
def _(t):
    values = t("produced").select("id", F.lit("brand").alias("field"), F.col("brand").alias("value"))
    maps = t("produced").where("brand in ('Brand#1', 'Brand#2')").select(F.lit("brand").alias("field"), F.col("brand").alias("old"), F.expr("case when brand = 'Brand#1' then 'first' end").alias("new")).distinct()
    return O.normalize(values, maps)


@query("src_value_maps", "SELECT DISTINCT 'brand' AS field, brand AS old, CASE WHEN brand = 'Brand#1' THEN 'first' END AS new FROM produced WHERE brand IN ('Brand#1', 'Brand#2')")
def _(t):
    rows = t("produced").where("brand in ('Brand#1', 'Brand#2')").select("brand").distinct()
    entry = F.expr("to_json(map('brand', map(brand, case when brand = 'Brand#1' then 'first' end)), map('ignoreNullFields', 'false'))")
    path = f"{store.shared_folder(t.spark)}/value-maps-{uuid.uuid4().hex}"
    rows.select(entry.alias("value")).write.text(path)
    return S.value_maps(t.spark, path)


# Records and lines ----------------------------------------------------------------------

DERIVED["record_lists"] = """
    SELECT l_orderkey, '[' || string_agg(CASE WHEN l_linenumber % 2 = 0 THEN '"line-' || CAST(l_linenumber AS STRING) || '"' ELSE '{"id": "' || CAST(l_linenumber AS STRING) || '", "title": "t", "url": "http://x/' || CAST(l_partkey AS STRING) || '"}' END, ',') || ']' AS body
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY l_orderkey, l_linenumber) x GROUP BY l_orderkey"""
_ITEMS = """items AS (SELECT l_orderkey, unnest(from_json(body, '["JSON"]')) AS r FROM record_lists),
    named AS (SELECT l_orderkey, CASE WHEN json_type(r) = 'VARCHAR' THEN r ->> '$' ELSE r ->> '$.id' END AS id, CASE WHEN json_type(r) = 'VARCHAR' THEN NULL ELSE r ->> '$.url' END AS url FROM items)"""


def _items(t):
    return S.explode_records(t("record_lists").select("l_orderkey", F.try_parse_json("body").alias("v")), "v")


@query("src_json_records", f"WITH {_ITEMS} SELECT l_orderkey, count(*) AS n FROM items GROUP BY 1")
def _(t):
    return _items(t).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("src_worklist", f"WITH {_ITEMS} SELECT id, url FROM named")
def _(t):
    """A work-list that is refused if an entry has no key."""
    return S.keyed(S.worklist(_items(t))).select("id", "url")


@query("worklist_keyless", f"WITH {_ITEMS} SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN json_type(r) = 'VARCHAR' THEN r ->> '$' ELSE r ->> '$.name' END AS id FROM items) WHERE id IS NULL GROUP BY 1")
def _(t):
    """By list the entries without a key, where keys are called ``name``."""
    listed = _items(t).withColumn("ordinal", F.struct("l_orderkey", "ordinal"))
    return S.keyless(S.worklist(listed, "name")).groupBy(F.col("ordinal.l_orderkey").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n"))


@query("src_drive_items", f"WITH {_ITEMS} SELECT coalesce(id, url) AS id, coalesce(url, id) AS url FROM named")
def _(t):
    return S.drive_items(_items(t)).select("id", "url")


@query("src_jsonl_tolerant", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN substr(props, 1, 4) WHEN event_id % 7 = 0 THEN ' ' ELSE props END AS props FROM events) WHERE json_valid(props)")
def _(t):
    line = F.expr("case when event_id % 5 = 0 then substr(props, 1, 4) when event_id % 7 = 0 then ' ' else props end")
    rows = S.tolerant_lines(t("events").select("event_id", line.alias("value")))
    return rows.select("event_id", F.expr("variant_get(record, '$.k', 'long')").alias("k"))


# Transcripts ----------------------------------------------------------------------------

#: A transcript per conversation: some end well, some in a tool call, some are torn or empty.
DERIVED["transcript_lines"] = """
    SELECT 'p/s/subagents/agent-' || CAST(conv_id AS STRING) || '.jsonl' AS path, turn AS line_no, conv_id,
        CASE WHEN conv_id % 7 = 6 THEN '{"torn'
            WHEN role = 'user' THEN '{"type": "user", "agentId": "a' || CAST(conv_id AS STRING) || '", "message": {"role": "user", "content": "' || CASE WHEN conv_id % 3 = 0 THEN '[gleaner-item: item' || CAST(conv_id AS STRING) || '] go' ELSE 'go' END || '"}}'
            WHEN conv_id % 7 = 5 THEN '{"type": "assistant", "message": {"role": "assistant", "stop_reason": "tool_use", "content": [{"type": "tool_use"}]}}'
            ELSE '{"type": "assistant", "message": {"role": "assistant", "stop_reason": "end_turn", "content": [{"type": "text", "text": "turn ' || CAST(turn AS STRING) || '"}]}}' END AS value
    FROM conversations"""
DERIVED["transcript_sidecars"] = """
    SELECT DISTINCT 'p/s/subagents/agent-' || CAST(conv_id AS STRING) || '.jsonl' AS path, CASE WHEN conv_id % 3 = 1 THEN 'described' END AS description, CASE WHEN conv_id % 2 = 0 THEN 'tool1' END AS tool_use_id, conv_id % 5 = 0 AS stopped
    FROM conversations"""
_FOLD = """
    lines AS (SELECT path, line_no, conv_id, CASE WHEN json_valid(value) THEN value END AS v FROM transcript_lines),
    per AS (SELECT path, any_value(conv_id) AS conv_id, count(v) AS n,
        arg_min(v ->> '$.message.content', line_no) FILTER (v ->> '$.type' = 'user') AS asked,
        arg_max(v ->> '$.message.stop_reason', line_no) FILTER (v ->> '$.type' = 'assistant') AS stop,
        arg_max(v ->> '$.message.content[0].text', line_no) FILTER (v ->> '$.type' = 'assistant' AND v ->> '$.message.content[0].type' = 'text') AS text,
        count(v) FILTER (v ->> '$.type' = 'assistant') AS answers,
        arg_min(coalesce(v ->> '$.agentId', '-'), line_no) FILTER (v IS NOT NULL) AS agent FROM lines GROUP BY path),
    folded AS (SELECT path, coalesce(nullif(agent, '-'), CAST(conv_id AS VARCHAR)) AS agent_id,
        coalesce(nullif(regexp_extract(asked, '\\[gleaner-item: ([^\\]]*)\\]', 1), ''), description, tool_use_id) AS target,
        CASE WHEN contains(asked, '[gleaner-item: ') THEN 'marker' WHEN description IS NOT NULL THEN 'description' WHEN tool_use_id IS NOT NULL THEN 'tool_use_id' END AS identified_by,
        CASE WHEN stop = 'end_turn' THEN text END AS text, coalesce(stop = 'end_turn', false) AS complete,
        CASE WHEN coalesce(stop = 'end_turn', false) THEN 'ok' WHEN stopped AND n > 0 THEN 'stopped-by-user' WHEN n = 0 THEN 'unreadable' WHEN answers = 0 THEN 'no-assistant' ELSE 'incomplete' END AS reason
        FROM per JOIN transcript_sidecars USING (path))"""


def _folded(t):
    return R.fold(t("transcript_lines").select("path", "line_no", "value"), t("transcript_sidecars"))


@query("transcript_fold", f"WITH {_FOLD} SELECT path, agent_id, text FROM folded")
def _(t):
    return _folded(t).select("path", "agent_id", "text")


@query("transcript_complete", f"WITH {_FOLD} SELECT path, complete, reason FROM folded")
def _(t):
    return _folded(t).select("path", "complete", "reason")


@query("identify", f"WITH {_FOLD} SELECT path, target, identified_by FROM folded")
def _(t):
    return _folded(t).select("path", "target", "identified_by")


@query("to_results", f"WITH {_FOLD} SELECT agent_id, text, path AS source, target AS item_id FROM folded WHERE complete AND coalesce(text, '') <> '' AND coalesce(target, '') <> ''")
def _(t):
    return R.to_results(_folded(t))


@query("recover", f"WITH {_FOLD} SELECT path FROM folded WHERE starts_with(agent_id, 'a1') AND contains(path, 'p/s')")
def _(t):
    lines, sidecars = t("transcript_lines").select("path", "line_no", "value"), t("transcript_sidecars")
    return commands.find_transcripts(lines, sidecars, ["a1"], "p/", "s/sub").select("path")


@query("recover_summary", f"WITH {_FOLD} SELECT count(*) AS transcripts, count(*) FILTER (complete AND target IS NOT NULL) AS recoverable, count(*) FILTER (identified_by = 'marker') AS by_marker, count(*) FILTER (identified_by = 'description') AS by_description, count(*) FILTER (identified_by = 'tool_use_id') AS by_tool_use_id FROM folded")
def _(t):
    return R.summary(_folded(t))


@query("recover_sorted", f"WITH {_FOLD} SELECT agent_id, path, reason, row_number() OVER (ORDER BY agent_id, path) AS place FROM folded")
def _(t):
    return ordered(_folded(t).select("agent_id", "path", "reason"), "agent_id", "path")


# Prompts --------------------------------------------------------------------------------

DERIVED["prompt_docs"] = """
    SELECT doc_id, '# Doc ' || CAST(doc_id AS STRING) || chr(10) || '**Prompt version: ' || CAST(doc_id % 9 AS STRING) || ' (2024-01-0' || CAST(1 + doc_id % 9 AS STRING) || ').**' || chr(10)
        || CASE WHEN doc_id % 4 > 0 THEN '## Drift guard' || chr(10) || 'keep  this' || chr(10) ELSE '' END || '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || '## Schema' || chr(10) || 'x' || chr(10) || '```yaml' || chr(10) || 'id: ' || CAST(doc_id AS STRING) || chr(10) || '```' || chr(10) || '## Provenance' || chr(10)
        || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '<!-- BEGIN PROMPT -->' END || chr(10) || 'Do {{task}} for {{id}}' || CASE WHEN doc_id % 6 = 0 THEN ' {{odd}}' ELSE '' END || chr(10) || CASE WHEN doc_id % 7 = 0 THEN '<!-- BEGIN PROMPT -->' ELSE '' END || '<!-- END PROMPT -->' AS doc,
        CASE WHEN doc_id % 8 = 0 THEN NULL ELSE lang END AS lang
    FROM documents"""


@query("slice_anchor", """SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 <> 0 THEN 'missing' WHEN doc_id % 7 = 0 AND doc_id % 5 <> 0 THEN 'repeated' END AS error,
    CASE WHEN doc_id % 5 = 0 AND doc_id % 7 = 0 THEN '' WHEN doc_id % 5 > 0 AND doc_id % 7 > 0 THEN 'Do {{task}} for {{id}}' || CASE WHEN doc_id % 6 = 0 THEN ' {{odd}}' ELSE '' END END AS body FROM prompt_docs""")
def _(t):
    return t("prompt_docs").select("doc_id", C.slice_anchors("doc").alias("s")).select("doc_id", "s.error", "s.body")


@query("md_headings", """SELECT doc_id, unnest(CASE WHEN doc_id % 4 > 0 THEN ['Doc ' || doc_id, 'Drift guard', 'Schema', 'Provenance'] ELSE ['Doc ' || doc_id, 'Schema', 'Provenance'] END) AS title FROM prompt_docs""")
def _(t):
    return C.headings(t("prompt_docs"), "doc_id", "doc").select("doc_id", "title")


@query("lift_block", "SELECT doc_id, 'id: ' || doc_id AS block FROM prompt_docs")
def _(t):
    return C.lift_block(t("prompt_docs"), "doc_id", "doc", "Schema")


@query("tmpl_placeholders", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(doc, '\{\{(\w+)\}\}', 1))), ',') AS names FROM prompt_docs")
def _(t):
    return t("prompt_docs").select("doc_id", F.array_join(C.placeholders("doc"), ",").alias("names"))


@query("set_placeholders", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'odd' ELSE '' END AS unknown FROM prompt_docs")
def _(t):
    return t("prompt_docs").select("doc_id", F.array_join(C.unknown_placeholders("doc", ["task", "id"]), ",").alias("unknown"))


@query("tmpl_validate", "SELECT doc_id, doc_id % 6 <> 0 AS valid FROM prompt_docs")
def _(t):
    return t("prompt_docs").select("doc_id", (F.size(C.unknown_placeholders("doc", ["task", "id"])) == 0).alias("valid"))


@query("tmpl_fill", """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'unknown: odd' WHEN lang IS NULL THEN 'null: task' END AS error,
    CASE WHEN doc_id % 6 > 0 AND lang IS NOT NULL THEN sha256(replace(replace(doc, '{{task}}', lang), '{{id}}', CAST(doc_id AS VARCHAR))) END AS sha FROM prompt_docs""")
def _(t):
    filled = C.fill("doc", {"task": F.col("lang"), "id": F.col("doc_id")})
    return t("prompt_docs").select("doc_id", filled.alias("f")).select("doc_id", "f.error", F.sha2("f.text", 256).alias("sha"))


@query("build_prompts", "SELECT id, 'Work on ' || coalesce(title, id) || ' of 2024-01-01' AS prompt FROM worklist")
def _(t):
    filled = C.fill(F.lit("Work on {{title}} of {{today}}"), {"title": F.coalesce("title", "id"), "today": F.lit("2024-01-01")})
    return t("worklist").select("id", filled["text"].alias("prompt"))


@query("version_of", "SELECT doc_id, CAST(doc_id % 9 AS INT) AS number, '2024-01-0' || (1 + doc_id % 9) AS dated FROM prompt_docs")
def _(t):
    return t("prompt_docs").select("doc_id", C.version("doc").alias("v")).select("doc_id", "v.number", "v.dated")


@query("check_protocol", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '## Drift guard' ELSE '' END AS missing FROM prompt_docs")
def _(t):
    return t("prompt_docs").select("doc_id", F.array_join(C.missing_phrases("doc", K.REQUIRED_HEADINGS, collapsed=False), ",").alias("missing"))


@query("guard_phrases", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'keep this,never' ELSE 'never' END AS missing FROM prompt_docs")
def _(t):
    return t("prompt_docs").select("doc_id", F.array_join(C.missing_phrases("doc", ["keep this", "never"]), ",").alias("missing"))


_RULE = "=" * K.RULE_WIDTH


@query("emit_block", f"SELECT id, sha256('{_RULE}' || chr(10) || '# gleaner-item: g/' || id || '  run=r1' || chr(10) || '{_RULE}' || chr(10) || '[gleaner-item: g/' || id || ']' || chr(10) || title || chr(10)) AS sha FROM worklist")
def _(t):
    b = C.block(F.col("title"), F.col("id"), F.lit("r1"), F.lit("g"))
    return t("worklist").select("id", F.sha2(b, 256).alias("sha"))


@query("marker_parse", "SELECT id, CASE WHEN ordinal % 5 = 1 THEN NULL ELSE 'g/' || id END AS item FROM worklist")
def _(t):
    b = F.when(F.col("ordinal") % 5 == 1, F.lit("[gleaner-item:  ] x")).otherwise(C.block(F.col("title"), F.col("id"), None, F.lit("g")))
    return t("worklist").select("id", N.marker_item(b).alias("item"))


@query(
    "emit_dry_run",
    """SELECT row_number() OVER (ORDER BY id) AS place, rtrim(rpad(id, 40, ' ') || '  ' || rpad(title, 40, ' ')) AS line FROM worklist
       UNION ALL SELECT count(*) + 1, count(*) || ' items' FROM worklist""",
)
def _(t):
    """A line to an item in order, and a last one with their number."""
    return C.dry_run(t("worklist"), "id", "title").withColumn("place", F.col("place").cast("long"))


@query("run_id", "SELECT o_orderkey AS id, 'run-' || strftime(o_orderdate, '%Y%m%dT%H%M') || '-' || substr(sha1('run:' || strftime(o_orderdate, '%Y%m%dT%H%M')), 1, 6) AS run FROM orders")
def _(t):
    return t("orders").select(F.col("o_orderkey").alias("id"), C.run_id(F.lit("run"), "o_orderdate").alias("run"))


_PLAN_DOCUMENT = "# Prompt\n\n**Prompt version: 7 (2024-05-06)**\n\nLook at {{title}}.\n"


@query("snk_plan", f"SELECT id, length(title) AS chars, sha256(title) AS sha256, 'r1' AS run, 7 AS prompt_version, '2024-05-06' AS prompt_dated, sha256('{_PLAN_DOCUMENT}') AS document_sha256 FROM worklist")
def _(t):
    """A plan's manifest, written and read back."""
    path = f"{store.shared_folder(t.spark)}/plan-{uuid.uuid4().hex}"
    found = C.plan_manifest(t("worklist"), "id", "title", _PLAN_DOCUMENT, "r1").withColumn("chars", F.col("chars").cast("long"))
    store.write_json(found, path)
    return versions.read(t.spark, path, found.schema)


@query("sec_assemble", "SELECT id, CASE WHEN ordinal % 2 = 0 THEN 'You check ' || id || chr(10) || chr(10) ELSE '' END || 'Answer with one block.' AS prompt FROM worklist")
def _(t):
    role = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit("You check "), "id"))
    return t("worklist").select("id", C.assemble({"output": F.lit("Answer with one block."), "role": role}).alias("prompt"))


# Plans of calls -------------------------------------------------------------------------


@query("src_batches", "SELECT 'size=' || p_size AS name, row_number() OVER (ORDER BY 'size=' || p_size) AS place, n FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1)")
def _(t):
    """Batch files as a folder holds them, a folder to a size of part, found and numbered in order."""
    path = f"{store.shared_folder(t.spark)}/batches-{uuid.uuid4().hex}"
    t("part").select("p_size", F.col("p_name").alias("value")).withColumnRenamed("p_size", "size").repartition("size").write.partitionBy("size").text(path)
    lines = t.spark.read.option("recursiveFileLookup", "true").text(path).select(F.regexp_extract("_metadata.file_path", "/(size=[^/]*)/", 1).alias("name"))
    counts = lines.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return W.discover(counts, "name").select("name", F.col("place").cast("long").alias("place")).join(counts, "name")


@query("sorted_batches", "SELECT id AS name, row_number() OVER (ORDER BY id) AS place FROM worklist WHERE regexp_matches(id, '^[^.].*7$')")
def _(t):
    return W.discover(t("worklist").select(F.col("id").alias("name")), "name", "^[^.].*7$").select("name", F.col("place").cast("long").alias("place"))


@query("wf_plan_calls", "SELECT id, 'Read ' || id || ' and ' || id AS prompt, 'm1' AS model FROM worklist")
def _(t):
    return W.plan_calls(t("worklist").select("id"), "id", "Read {{file}} and {{file}}", "m1")


@query("model_pinned", "SELECT id FROM worklist WHERE ordinal % 3 = 1")
def _(t):
    calls = t("worklist").select("id", F.expr("case when ordinal % 3 = 1 then '' else 'm1' end").alias("model"))
    return W.unpinned(calls).select("id")


@query("nominate", "SELECT 'claim ' || o_orderkey AS claim, o_orderkey % 3 AS n FROM orders WHERE o_orderkey % 3 >= 1")
def _(t):
    claims = F.expr("array(struct(concat('claim ', o_orderkey) as claim, slice(array('s1', 's2'), 1, cast(o_orderkey % 3 as int)) as sources))")
    return W.nominate(t("orders").select(claims.alias("safety_claims")), "safety_claims").select("claim", F.size("sources").cast("long").alias("n"))


_CLAIMS = "array(struct(concat('claim ', o_orderkey) as claim, slice(array('s1', 's2'), 1, cast(o_orderkey % 3 as int)) as sources))"


@query("wf_verify_calls", """SELECT 'claim ' || o_orderkey AS claim, 'Try to refute this claim with independent primary sources: "claim ' || o_orderkey || '"' || chr(10) || 'If the evidence is mixed or stale, answer uncertain; then the original stays and a person decides.' AS prompt, 'm1' AS model, o_orderkey % 3 AS sources FROM orders WHERE o_orderkey % 3 >= 1""")
def _(t):
    """A call for each claim that has sources, with its prompt and its model."""
    return W.verify_calls(W.nominate(t("orders").select(F.expr(_CLAIMS).alias("c")), "c"), "m1")


@query("wf_dry_run", "SELECT 1 AS stage, count(*) AS calls, count(*) FILTER (ordinal % 3 = 1) AS unpinned, NULL AS note FROM worklist UNION ALL SELECT 2, NULL, NULL, 'not computed until stage one has run'")
def _(t):
    """A chain that isn't run: the second stage's calls depend on replies that aren't there."""
    calls = t("worklist").select("id", F.expr("case when ordinal % 3 = 1 then '' else 'm1' end").alias("model"))
    return W.dry_run(calls, "not computed until stage one has run")
