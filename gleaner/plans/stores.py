"""Queries that go through files and tables, and the parts of prompts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import html as H
from ..functions import sql as Q
from ..operators import commands as C
from ..operators import compose
from ..operators import linkstate as L
from ..operators import media as M
from ..operators import sections as P
from ..operators import workflows as W
from ..sources import readers, store, versions
from . import fanout as _fanout
from .base import query


def _new(t, name: str) -> str:
    return f"{store.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _fussy(body: str | None) -> dict:
    """A parser that fails on some pages."""
    n = len(body or "")
    if n % 10 == 7:
        raise ValueError(f"a body of {n} characters")
    return {"chars": n}


@query(
    "snk_raw_first",
    """SELECT page_id AS id, length(html) AS chars, CASE WHEN length(html) % 10 <> 7 THEN length(html) END AS parsed_chars,
           CASE WHEN length(html) % 10 = 7 THEN 'ValueError: a body of ' || length(html) || ' characters' END AS error, CASE WHEN page_id % 2 = 0 THEN url END AS url FROM made_pages""",
)
def _(t):
    """Raw pages are written before they are parsed; where the parser fails, raw and the error are kept, and all else is parsed."""
    path = _new(t, "raw")
    pages = t("made_pages").select(F.col("page_id").alias("id"), F.col("html").alias("body"))
    meta = t("made_pages").where("page_id % 2 = 0").select(F.col("page_id").alias("id"), "url", F.lit(None).cast("timestamp").alias("fetched_at"))
    parsed = store.harvest(pages, _fussy, path, _new(t, "parsed"), meta)
    found = t.spark.read.parquet(path).join(parsed, "id")
    return found.select("id", F.length("body").cast("long").alias("chars"), F.get_json_object("record", "$.chars").cast("long").alias("parsed_chars"), "error", "url")


@query("snk_read_back", "SELECT page_id AS id, sha256(html) AS sha FROM made_pages WHERE page_id % 5 = 2")
def _(t):
    path = _new(t, "raw")
    store.write_raw(t("made_pages").select(F.col("page_id").alias("id"), F.col("html").alias("body")), path)
    ids = t("pages").where("page_id % 5 = 2").select(F.col("page_id").alias("id"))
    return store.read_back(t.spark, path, ids).select("id", F.sha2("body", 256).alias("sha"))


@query("snk_parsed", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status FROM orders")
def _(t):
    """One JSON object per line, null fields kept, read back with a schema."""
    path = _new(t, "parsed")
    store.write_json(t("orders").select(F.col("o_orderkey").alias("id"), F.expr("case when o_orderkey % 3 > 0 then o_orderstatus end").alias("status")), path)
    return versions.read(t.spark, path, "id long, status string")


@query("src_linkstate", "SELECT url, http_status, verified_via FROM link_states")
def _(t):
    """A state file, objects by url, written and read back."""
    path = _new(t, "state")
    store.write_states(t("link_states").select("url", "http_status", "verified_via"), path)
    return readers.link_states(t.spark, path, "http_status: int, verified_via: string")


@query(
    "src_replies",
    """SELECT CASE WHEN k % 2 = 0 THEN 'agent-' || k ELSE CAST(k AS VARCHAR) END AS agent_id, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END AS item_id, n || ' orders' || chr(10) AS text
       FROM (SELECT o_custkey % 40 AS k, count(*) AS n FROM orders GROUP BY 1)""",
)
def _(t):
    """A file for each of forty groups of customers, with an index that names some agents."""
    path = _new(t, "replies")
    orders = t("orders").groupBy((F.col("o_custkey") % 40).cast("string").alias("stem")).count()
    orders.select("stem", F.concat(F.col("count").cast("string"), F.lit(" orders")).alias("value")).repartition("stem").write.partitionBy("stem").text(path)
    index = orders.where("cast(stem as long) % 2 = 0").select(F.col("stem").alias("item_id"), F.concat(F.lit("agent-"), "stem").alias("agent_id"))
    return readers.replies(t.spark, path, index, "/stem=([^/]*)/").select("agent_id", "item_id", "text")


@query("src_transcripts", "SELECT regexp_extract(path, '[^/]*$') AS file, line_no, value FROM transcript_lines")
def _(t):
    """Whole transcripts written as rows, read back line by line with their places."""
    path = _new(t, "transcripts")
    whole = t("transcript_lines").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_no", "value"))).alias("l"))
    whole.select("path", F.array_join("l.value", "\n").alias("value")).write.parquet(path)
    rows = readers.transcript_lines(t.spark.read.parquet(path))
    return rows.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), F.col("line_no").cast("long").alias("line_no"), "value")


@query("src_transcript_files", "SELECT o_custkey % 30 AS agent, count(*) AS n_lines, sum(o_orderkey) AS total FROM orders GROUP BY 1")
def _(t):
    """Transcripts as files below project/session/subagents, one for each of thirty groups of customers."""
    path = _new(t, "project")
    rows = t("orders").select((F.col("o_custkey") % 30).alias("agent"), F.col("o_orderkey").cast("string").alias("value"))
    rows.repartition("agent").write.partitionBy("agent").text(f"{path}/session/subagents")
    found = readers.transcripts(t.spark, path, "part-*", "/subagents/agent=[0-9]+/").where("value <> ''")
    agent = F.regexp_extract("path", "/agent=([0-9]+)/", 1).cast("long")
    return found.groupBy(agent.alias("agent")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("value").cast("long")).alias("total"))


@query("sweep_in_place", "SELECT s.url, CASE WHEN coalesce(verified_via = 'fetch_js', false) AND http_status IN (200, 301, 302, 303, 307, 308) THEN http_status ELSE coalesce(head, -1) END AS http_status, '2024-03-04' AS last_checked, 3 AS version FROM link_states s LEFT JOIN probes p USING (url)")
def _(t):
    """States are written once and swept twice at the same path; each sweep is a version of its own."""
    path = _new(t, "swept")
    store.write_states(t("link_states").select("url", "http_status", F.lit("2024-01-01").alias("last_checked"), "verified_via"), path)
    probed = t("probes").select("url", F.coalesce("head", F.lit(-1)).alias("status"))
    fields = "http_status: int, last_checked: string, verified_via: string"
    for day in ("2024-03-03", "2024-03-04"):
        done = C.sweep_files(t.spark, path, probed, day, fields)
    return readers.link_states(t.spark, path, fields).select("url", "http_status", "last_checked", F.lit(done["version"]).cast("int").alias("version"))


@query("src_sidecar_files", "SELECT conv_id % 40 AS k, 'of ' || count(*) AS description, CASE WHEN conv_id % 40 % 2 = 0 THEN 'tool' END AS tool_use_id, count(*) % 2 = 0 AS stopped FROM conversations GROUP BY conv_id % 40")
def _(t):
    """A file for each of forty groups of conversations, read back as the sidecar of a transcript."""
    path = _new(t, "sidecars")
    n, k = F.count(F.lit(1)), F.col("agent")
    packed = t("conversations").groupBy((F.col("conv_id") % 40).alias("agent")).agg(n.alias("n"))
    value = F.to_json(F.struct(F.concat(F.lit("of "), "n").alias("description"), F.when(k % 2 == 0, "tool").alias("toolUseId"), (F.col("n") % 2 == 0).alias("stoppedByUser")))
    packed.select("agent", value.alias("value")).repartition("agent").write.partitionBy("agent").text(path)
    found = readers.sidecars(t.spark, path, "part-*", r"/part-[^/]*$")
    return found.select(F.regexp_extract("path", r"agent=([0-9]+)\.jsonl$", 1).cast("long").alias("k"), "description", "tool_use_id", "stopped")


@query("src_sidecar", "SELECT path, coalesce(description, '') AS description, coalesce(tool_use_id, '') AS tool_use_id, stopped FROM transcript_sidecars")
def _(t):
    packed = t("transcript_sidecars").select("path", F.to_json(F.struct("description", F.col("tool_use_id").alias("toolUseId"), F.col("stopped").alias("stoppedByUser"))).alias("value"))
    found = readers.parse_sidecars(packed)
    return found.select("path", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("tool_use_id", F.lit("")).alias("tool_use_id"), "stopped")


@query("snk_recovered", f"WITH {_fanout._FOLD} SELECT target AS item_id, agent_id, text FROM folded WHERE complete AND coalesce(text, '') <> '' AND coalesce(target, '') <> '' QUALIFY row_number() OVER (PARTITION BY target ORDER BY path DESC) = 1")
def _(t):
    """Recovered replies as text files and an index from items to agents, read back as replies."""
    path = _new(t, "recovered")
    store.write_replies(C.recover(t("transcript_lines").select("path", "line_no", "value"), t("transcript_sidecars")), path)
    index = t.spark.read.schema("item_id string, agent_id string").json(f"{path}/index")
    return readers.replies(t.spark, f"{path}/replies", index, "/stem=([^/]*)/").select("item_id", "agent_id", F.regexp_replace("text", "\n$", "").alias("text"))


@query("snk_report", "SELECT mktsegment, n, note FROM (SELECT c_mktsegment AS mktsegment, count(*) AS n, CASE WHEN count(*) % 2 = 0 THEN 'even' END AS note FROM customer GROUP BY 1)")
def _(t):
    """A report as JSON, written and read back; null fields are kept."""
    n = F.count(F.lit(1))
    counted = t("customer").groupBy(F.col("c_mktsegment").alias("mktsegment")).agg(n.alias("n"), F.when(n % 2 == 0, "even").alias("note"))
    path = _new(t, "report")
    store.report(counted).write.text(path)
    lines = t.spark.read.text(path).where(F.array_contains(F.json_object_keys("value"), "note"))
    return lines.select(F.from_json("value", "mktsegment string, n long, note string").alias("r")).select("r.*")


@query("html_entities", "SELECT page_id, 'a<' || page_id || '> é € & &bogus; &lt; \" \U0001f600\U0001f600 \ufffd A &amp; & &#1114112; ' || chr(13) AS text FROM pages")
def _(t):
    raw = F.concat(F.lit("a&lt;"), F.col("page_id").cast("string"), F.lit("&gt; &#233; &#x20AC; &amp; &bogus; &amp;lt; &quot; &#128512;&#x1F600; &#65533; &#0000065; &#38;amp; &AMP; &#1114112; &#xD;"))
    return t("pages").select("page_id", H.decode_entities(raw).alias("text"))


@query("html_regex_quote", "SELECT page_id, strpos(url, '.example.') > 0 AS found, strpos(html, '(' || page_id % 7 || ')') > 0 AS numbered FROM pages")
def _(t):
    number = F.concat(F.lit("("), (F.col("page_id") % 7).cast("string"), F.lit(")"))
    return t("pages").select("page_id", F.regexp_like("url", H.regex_quote(F.lit(".example."))).alias("found"), F.regexp_like("html", H.regex_quote(number)).alias("numbered"))


@query(
    "max_buffer",
    """SELECT media_id, max(size) AS size, arg_min(seq, struct_pack(s := -size, q := seq)) AS seq FROM (
         SELECT p_partkey AS seq, CAST(p_partkey % 25 AS VARCHAR) AS media_id, p_size * 1000 AS size FROM part) WHERE size > 10000 GROUP BY 1""",
)
def _(t):
    """Parts as responses with a buffer each: per image the largest, of equals the first."""
    rows = t("part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("https://cdn.example.com/media/"), (F.col("p_partkey") % 25).cast("string"), F.lit("/full.jpg")).alias("url"), (F.col("p_size") * 1000).alias("size"))
    return M.largest_media(rows, "/media/([0-9]+)/", F.col("size") > K.MIN_JPEG_BYTES)


def _listed(*codes: str) -> str:
    """The markers of locales as a list of SQL, each once, in order."""
    words = dict.fromkeys(m.lower() for code in codes for m in K.LOCALES[code]["challenge_markers"])
    return "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in words) + "]"


@query("set_locale_dedupe", f"SELECT page_id, len(m) AS n, array_to_string(m, '|') AS shown FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {_listed('es', 'it')} ELSE {_listed('en', 'en', 'es')} END AS m FROM pages)")
def _(t):
    """The markers of several locales, each once, in order."""
    shown = F.when(F.col("page_id") % 2 == 0, F.array(*map(F.lit, K.markers("challenge_markers", ("es", "it"))))).otherwise(F.array(*map(F.lit, K.markers("challenge_markers", ("en", "en", "es")))))
    return t("pages").select("page_id", F.size(shown).cast("long").alias("n"), F.array_join(shown, "|").alias("shown"))


@query("compose", "SELECT id, 'Look at ' || title || '.' AS text FROM worklist")
def _(t):
    filled = compose.fill(F.lit("Look at {{title}}.{{note}}"), {"title": F.col("title"), "note": F.lit("")})
    return t("worklist").select("id", filled["text"].alias("text"))


@query("guards", "SELECT doc_id, unnest(CASE WHEN doc_id % 4 > 0 THEN ['Drift guard'] ELSE [] END) AS guard FROM prompt_docs")
def _(t):
    return compose.headings(t("prompt_docs"), "doc_id", "doc").where("title = 'Drift guard'").select("doc_id", F.col("title").alias("guard"))


_ROLE = "'You do one task, check, for one target: ' || id || '.'"


@query("sec_role", f"SELECT id, {_ROLE} AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.role(F.lit("check"), F.col("id")).alias("part"))


@query("sec_output_reply", "SELECT id, 'Answer with one fenced json block and nothing around it. Write no files.' AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.output_reply().alias("part"))


@query("sec_output_file", "SELECT id, 'Write the result to out/' || id || '.json and answer with one line: the number of records written.' AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.output_file(F.concat(F.lit("out/"), "id", F.lit(".json"))).alias("part"))


@query("sec_schema", "SELECT id, '## Schema' || chr(10) || chr(10) || '```yaml' || chr(10) || 'id: ' || id || chr(10) || '```' AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.schema(F.concat(F.lit("id: "), "id")).alias("part"))


@query("sec_census", "SELECT id, 'List every one of the items where ' || title || '; a sample is not enough.' AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.census(F.lit("items"), F.col("title")).alias("part"))


@query("sec_self_report", "SELECT id, 'Begin with the line `# verification: N of M items from ' || title || '. Excluded: names or none.`' AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.self_report(F.col("title")).alias("part"))


@query("sec_grounding", "SELECT id, 'State only what you saw in a source that you did fetch, and name the source.' AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.grounding().alias("part"))


_NAMES = "slice(array(id, title), 1, cast(ordinal % 3 as int))"


@query("sec_blocked", "SELECT id, CASE ordinal % 3 WHEN 0 THEN '' WHEN 1 THEN 'Do not use:' || chr(10) || '- ' || id ELSE 'Do not use:' || chr(10) || '- ' || id || chr(10) || '- ' || title END AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.blocked(F.expr(_NAMES)).alias("part"))


@query("sec_anti_list", "SELECT id, CASE ordinal % 3 WHEN 0 THEN '' WHEN 1 THEN 'These are already known and do not count:' || chr(10) || '- ' || id ELSE 'These are already known and do not count:' || chr(10) || '- ' || id || chr(10) || '- ' || title END AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.anti_list(F.expr(_NAMES)).alias("part"))


@query("sec_field_rules", "SELECT id, 'Fields:' || chr(10) || '- title: like ' || title AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.field_rules(F.expr("array(struct('title' as field, concat('like ', title) as rule))")).alias("part"))


@query("sec_verdict_guide", "SELECT id, 'Allowed verdicts:' || chr(10) || '- ok' || chr(10) || '- unparseable' || chr(10) || '- access_blocked' AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.verdict_guide("coverage_status").alias("part"))


@query("sec_scalar_request", "SELECT id, 'Count the items that the source of ' || id || ' lists. Report the count and a status; judge nothing.' AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.scalar_request(F.col("id")).alias("part"))


@query("sec_refute", "SELECT id, 'Try to refute: ' || title AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.refute(F.col("title")).alias("part"))


@query("sec_process", "SELECT id, CASE ordinal % 3 WHEN 0 THEN '' WHEN 1 THEN '1. ' || id ELSE '1. ' || id || chr(10) || '2. ' || title END AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.process(F.expr(_NAMES)).alias("part"))


@query("sec_restatement", "SELECT id, 'Remember: Answer ' || id AS part FROM worklist")
def _(t):
    return t("worklist").select("id", P.restatement(F.concat(F.lit("Answer "), "id", F.lit("\nonce"))).alias("part"))


@query("sec_build", f"SELECT id, {_ROLE} || chr(10) || chr(10) || 'Try to refute: ' || title || chr(10) || chr(10) || 'Remember: Try to refute: ' || title AS prompt FROM worklist")
def _(t):
    out = P.refute(F.col("title"))
    parts = {"restatement": P.restatement(out), "output": out, "role": P.role(F.lit("check"), F.col("id")), "anti_list": F.lit("")}
    return t("worklist").select("id", compose.assemble(parts).alias("prompt"))


@query("wf_normalize_args", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(props ->> '$.k' AS BIGINT) END AS k FROM events")
def _(t):
    args = W.normalize_args(F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.col("props")))
    return t("events").select("event_id", F.try_variant_get(args, "$.k", "long").alias("k"))


@query("wf_research_calls", "SELECT id, 'Research ' || id AS prompt, 'm1' AS model FROM worklist")
def _(t):
    return W.plan_calls(t("worklist").select("id"), "id", "Research {{file}}", "m1")


@query("wf_verify_prompt", "SELECT o_orderkey, 'Try to refute this claim with independent primary sources: \"' || o_orderpriority || '\"' || chr(10) || 'If the evidence is mixed or stale, answer uncertain; then the original stays and a person decides.' AS prompt FROM orders")
def _(t):
    return t("orders").select("o_orderkey", W.verify_prompt("o_orderpriority").alias("prompt"))


@query("wf_batch_fanout", "SELECT ordinal // 32 AS batch, string_agg('Read ' || id, ' ' ORDER BY ordinal) AS prompts FROM worklist GROUP BY 1")
def _(t):
    from ..operators.fanout import batches

    calls = W.plan_calls(t("worklist").select("id"), "id", "Read {{file}}", "m1").join(batches(t("worklist")), "id")
    grouped = calls.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("ordinal", "prompt"))).alias("p"))
    return grouped.select("batch", F.array_join("p.prompt", " ").alias("prompts"))


@query("wf_research_verify", "SELECT 'claim ' || o_orderkey AS claim, 'm1' AS model FROM orders WHERE o_orderkey % 3 >= 1")
def _(t):
    """Two stages: claims of the first that have sources become calls of the second."""
    claims = F.expr("array(struct(concat('claim ', o_orderkey) as claim, slice(array('s1', 's2'), 1, cast(o_orderkey % 3 as int)) as sources))")
    second = W.nominate(t("orders").select(claims.alias("safety_claims")), "safety_claims")
    return W.plan_calls(second.select("claim"), "claim", "Check {{file}}", "m1").select("claim", "model")


@query("wf_cli_args", """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'dry-run' ELSE 'key' END AS name, CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN '"' || event_type || '"' ELSE 'true' END AS value FROM events""")
def _(t):
    """``--key=value`` texts to values: JSON where it parses, else text; a bare name is true."""
    n = F.col("event_id") % 3
    arg = F.when(n == 0, F.concat(F.lit("--key="), F.col("event_id").cast("string"))).when(n == 1, F.concat(F.lit("--key="), "event_type")).otherwise("--dry-run")
    return t("events").select("event_id", W.cli_arg(arg).alias("a")).select("event_id", "a.*")


@query("sql_functions", "SELECT c_custkey AS id, (c_custkey % 5 = 0 OR c_custkey % 7 = 0) AS empty, lower(c_name) AS norm FROM customer")
def _(t):
    """The SQL layer over a table."""
    Q.register(t.spark)
    rows = t("customer").select(F.col("c_custkey").alias("id"), "c_name", F.expr("case when c_custkey % 5 = 0 then null when c_custkey % 7 = 0 then ' - ' else c_name end").alias("name"))
    return rows.selectExpr("id", "is_empty_value(name) as empty", "text_norm(c_name) as norm")


@query(
    "sweep",
    """SELECT s.url, CASE WHEN coalesce(verified_via = 'fetch_js', false) AND http_status IN (200, 301, 302, 303, 307, 308) THEN http_status ELSE coalesce(head, -1) END AS http_status, '2024-03-03' AS last_checked
       FROM link_states s LEFT JOIN probes p USING (url)""",
)
def _(t):
    states = t("link_states").select("url", "http_status", F.lit("2024-01-01").alias("last_checked"), "verified_via")
    probed = t("probes").select("url", "head").select("url", F.coalesce("head", F.lit(-1)).alias("status"))
    return C.sweep(states, probed, "2024-03-03").select("url", "http_status", "last_checked")


@query("plan_prompts", f"SELECT id, sha256('{'=' * 78}' || chr(10) || '# gleaner-item: ' || id || '  run=r9' || chr(10) || '{'=' * 78}' || chr(10) || '[gleaner-item: ' || id || ']' || chr(10) || 'See ' || title || chr(10)) AS sha FROM worklist WHERE id NOT IN (SELECT id FROM done WHERE {_fanout._FINISHED})")
def _(t):
    found = C.plan(t("worklist"), t("done"), "See {{title}}", {"title": F.col("title")}, "r9")
    return found.select("id", F.sha2("block", 256).alias("sha"))


@query("ingest_census", f"WITH {_fanout._LEDGER}, got AS (SELECT DISTINCT item_id AS id FROM ledger WHERE bucket = 'applied') SELECT coalesce(w.id, g.id) AS id, CASE WHEN w.id IS NULL THEN 'extra' WHEN g.id IS NULL THEN 'missing' ELSE 'matched' END AS class FROM (SELECT id FROM worklist) w FULL JOIN got g ON w.id = g.id")
def _(t):
    return C.ingest(t("replies"), t("dispatched"), t("worklist"), schema_keys=["item_id", "title", "note", "records"])[1]


@query("ingest_exit", "SELECT 1 AS exit_code FROM replies LIMIT 1")
def _(t):
    _, census, found = C.ingest(t("replies"), t("dispatched"), t("worklist"), schema_keys=["item_id", "title", "note", "records"])
    return C.ingest_exit(census, found)


@query("linkstate_live_hosts", "SELECT lower(regexp_extract(url, '//([^/:]*)', 1)) AS host, count(*) AS n FROM link_states WHERE http_status IN (200, 301, 302, 303, 307, 308) GROUP BY 1")
def _(t):
    from ..functions import urls as U

    return t("link_states").where(L.is_live("http_status")).groupBy(U.host("url").alias("host")).agg(F.count(F.lit(1)).alias("n"))
