"""Queries on record tables: census, agreement, echoes, matches, measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..operators import matching as M
from ..operators import quality as Q
from ..operators import scalars as S
from ..sources import store
from .base import DERIVED, query

#: Customers with blanks of every kind.
DERIVED["records"] = """
    SELECT c_custkey AS id,
        CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '-' WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_name END AS name,
        CASE WHEN c_custkey % 3 = 0 THEN ' N/A ' WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 35 = 0 THEN NULL ELSE c_mktsegment END AS segment,
        CASE WHEN c_custkey % 7 = 0 OR c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance
    FROM customer"""

#: Two passes over the same orders that differ in case, spacing, values and coverage.
DERIVED["pass_a"] = """
    SELECT o_orderkey AS id, o_orderpriority AS priority, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderstatus END AS status, o_totalprice AS price
    FROM orders WHERE o_orderkey % 13 <> 1"""
DERIVED["pass_b"] = """
    SELECT o_orderkey AS id,
        CASE WHEN o_orderkey % 6 = 0 THEN 'changed' ELSE '  ' || lower(o_orderpriority) || ' ' END AS priority,
        CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE o_orderstatus END AS status,
        CASE WHEN o_orderkey % 10 = 3 THEN o_totalprice + 100 ELSE o_totalprice END AS price
    FROM orders WHERE o_orderkey % 13 <> 0"""

#: Titles of which some are addresses.
DERIVED["titles"] = """
    SELECT doc_id, CASE
        WHEN doc_id % 9 = 0 THEN 'https://example.com/' || CAST(doc_id AS STRING)
        WHEN doc_id % 9 = 2 THEN 'a-page-with-a-very-long-name-' || CAST(doc_id AS STRING) || '.html'
        WHEN doc_id % 9 = 4 THEN 'a%20page%20' || CAST(doc_id AS STRING)
        WHEN doc_id % 9 = 6 THEN '12-34-56-78-90-12-34-56-78-90 100% of ' || CAST(doc_id AS STRING)
        WHEN doc_id % 9 = 7 THEN ''
        ELSE substr(text, 1, 40) END AS title
    FROM documents"""

DERIVED["measurements"] = """
    SELECT o_orderkey AS item_id,
        CASE WHEN o_orderkey % 7 = 0 THEN 'access_blocked' WHEN o_orderkey % 11 = 0 THEN 'unparseable' ELSE 'ok' END AS status,
        CASE WHEN o_orderkey % 8 = 0 THEN 0 ELSE 1 + o_orderkey % 6 END AS source_count
    FROM orders"""
DERIVED["stored_counts"] = "SELECT l_orderkey AS item_id, count(*) AS stored_count FROM lineitem GROUP BY l_orderkey"

_EMPTY = "({c} IS NULL OR {c} = '' OR lower(trim({c})) IN ('-', 'n/a'))"
_FIELDS = ("name", "segment", "balance")


def _empty(c: str) -> str:
    return _EMPTY.format(c=f"CAST({c} AS VARCHAR)")


_CENSUS = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {i} AS pos, count(*) FILTER (NOT {_empty(f)}) AS filled, count(*) AS total, coalesce(count(*) FILTER (NOT {_empty(f)}) / nullif(count(*), 0), 0.0) AS rate FROM {{src}}"
    for i, f in enumerate(_FIELDS)
)
_NORM = "replace(lower(trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))), 'ß', 'ss')"


@query("is_empty", f"SELECT id, {_empty('name')} AS name_empty, {_empty('segment')} AS segment_empty FROM records")
def _(t):
    return t("records").select("id", T.is_empty("name").alias("name_empty"), T.is_empty("segment").alias("segment_empty"))


@query("is_present", "SELECT id, coalesce(name <> '', false) AS name_present, coalesce(segment <> '', false) AS segment_present FROM records")
def _(t):
    return t("records").select("id", T.is_present("name").alias("name_present"), T.is_present("segment").alias("segment_present"))


@query("field_census", f"SELECT field, filled, total, round(rate, 9) AS rate FROM ({_CENSUS.format(src='records')})")
def _(t):
    return Q.field_census(t("records"), list(_FIELDS)).select("field", "filled", "total", F.round("rate", 9).alias("rate"))


@query(
    "open_field_census",
    f"SELECT field, filled, round(rate, 9) AS rate FROM ({_CENSUS.format(src='records')}) WHERE field <> 'balance'",
)
def _(t):
    rows = t("records").select(F.map_filter(F.create_map(F.lit("name"), "name", F.lit("segment"), "segment"), lambda _, v: v.isNotNull()).alias("fields"))
    return Q.open_field_census(rows, "fields").select("field", "filled", F.round("rate", 9).alias("rate"))


@query("empty_records", f"SELECT id FROM records WHERE {' AND '.join(_empty(f) for f in _FIELDS)}")
def _(t):
    return Q.empty_records(t("records"), "id", list(_FIELDS))


@query("census_thin", f"SELECT field FROM ({_CENSUS.format(src='records')}) WHERE rate < 0.7")
def _(t):
    return Q.thin(Q.field_census(t("records"), list(_FIELDS)), 0.7).select("field")


@query("census_sorted", f"SELECT field, row_number() OVER (ORDER BY rate, pos) AS place FROM ({_CENSUS.format(src='records')})")
def _(t):
    return Q.sorted_census(Q.field_census(t("records"), list(_FIELDS))).select("field", "place")


_COMPARE = f"""
    SELECT field, CASE WHEN abs(coalesce(b.rate, 0) - coalesce(a.rate, 0)) <= 0.01 THEN 0.0 ELSE coalesce(b.rate, 0) - coalesce(a.rate, 0) END AS delta
    FROM ({_CENSUS.format(src="(SELECT * FROM records WHERE id % 2 = 0)")}) a FULL JOIN ({_CENSUS.format(src="(SELECT id, name, CASE WHEN id % 10 < 4 THEN NULL ELSE segment END AS segment, balance FROM records WHERE id % 2 = 1)")}) b USING (field)"""


def _halves(t):
    rows = t("records")
    before = rows.where("id % 2 = 0")
    after = rows.where("id % 2 = 1").withColumn("segment", F.expr("case when id % 10 < 4 then null else segment end"))
    return Q.census_compare(Q.field_census(before, list(_FIELDS)), Q.field_census(after, list(_FIELDS)), 0.01)


@query("census_compare", f"SELECT field, round(delta, 9) AS delta FROM ({_COMPARE})")
def _(t):
    return _halves(t).select("field", F.round("delta", 9).alias("delta"))


@query("census_regress", f"SELECT field, round(delta, 9) AS delta FROM ({_COMPARE}) WHERE delta < 0")
def _(t):
    return _halves(t).where("delta < 0").select("field", F.round("delta", 9).alias("delta"))


_BUCKET = "CAST(CAST(round((CAST({c} AS DOUBLE) - ((CAST({c} AS DOUBLE) % 0.5) + 0.5) % 0.5) / 0.5) AS BIGINT) AS VARCHAR)"


def _long(src: str, side: str) -> str:
    return " UNION ALL ".join(
        f"SELECT id, '{f}' AS field, CAST({f} AS VARCHAR) AS value_{side}, {_BUCKET.format(c=f) if f == 'price' else _NORM.format(c=f)} AS norm_{side} FROM {src} WHERE coalesce(CAST({f} AS VARCHAR), '') <> ''"
        for f in ("priority", "status", "price")
    )


_AGREE = f"""
    compared AS (
        SELECT id, field, CASE WHEN norm_a IS NULL THEN 'only_in_b' WHEN norm_b IS NULL THEN 'only_in_a' WHEN norm_a = norm_b THEN 'agreed' ELSE 'disputed' END AS class, value_a, value_b
        FROM ({_long('pass_a', 'a')}) a FULL JOIN ({_long('pass_b', 'b')}) b USING (id, field))"""


def _agreement(t):
    fields = {"priority": None, "status": None, "price": lambda f: T.number_norm(f, 0.5)}
    return Q.agreement(t("pass_a"), t("pass_b"), "id", fields)


@query("agree_compare", f"WITH {_AGREE} SELECT id, field, class, CASE WHEN field <> 'price' THEN value_a END AS value_a, CASE WHEN field <> 'price' THEN value_b END AS value_b FROM compared")
def _(t):
    shown = lambda c: F.when(F.col("field") != "price", F.col(c)).alias(c)  # noqa: E731  engines print doubles differently
    return _agreement(t).select("id", "field", "class", shown("value_a"), shown("value_b"))


@query("agree_counts", f"WITH {_AGREE} SELECT class, count(*) AS n FROM compared GROUP BY 1")
def _(t):
    return _agreement(t).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("agree_rate", f"WITH {_AGREE} SELECT round(count(*) FILTER (class = 'agreed') / count(*) FILTER (class IN ('agreed', 'disputed')), 9) AS rate FROM compared")
def _(t):
    return Q.agreement_rate(_agreement(t)).select(F.round("rate", 9).alias("rate"))


@query("agree_apply", f"WITH {_AGREE} SELECT id, field, value_a AS value FROM compared WHERE class = 'agreed' AND field <> 'price'")
def _(t):
    return Q.agreed_values(_agreement(t)).where("field <> 'price'")


@query("txt_norm", f"SELECT doc_id, sha256({_NORM.format(c='text')}) AS norm FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2(T.text_norm("text"), 256).alias("norm"))


@query("txt_collapse", "SELECT doc_id, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS chars FROM documents")
def _(t):
    return t("documents").select("doc_id", F.length(T.collapse("text")).cast("long").alias("chars"))


@query("num_norm", f"SELECT o_orderkey, {_BUCKET.format(c='o_totalprice')} AS bucket FROM orders")
def _(t):
    return t("orders").select("o_orderkey", T.number_norm("o_totalprice", 0.5).alias("bucket"))


_TOKENS = "list_distinct(list_transform(regexp_extract_all({c}, '[a-zA-Zа-яА-ЯёЁ]{{4,}}'), lambda x: replace(lower(x), 'ß', 'ss')))"


@query("txt_tokenize", f"SELECT doc_id, len({_TOKENS.format(c='text')}) AS n_tokens, sha256(array_to_string(list_sort({_TOKENS.format(c='text')}), ' ')) AS sha FROM documents")
def _(t):
    found = store.spread(t("documents").select("doc_id", "text")).select("doc_id", T.tokens("text").alias("t"))
    return found.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("sha"))


_NEXT = f"(SELECT doc_id, {_TOKENS.format(c='text')} AS a, {_TOKENS.format(c='reverse(text)')} AS b FROM documents)"


@query("txt_overlap", f"SELECT doc_id, round(coalesce(len(list_intersect(a, b)) / nullif(least(len(a), len(b)), 0), 0.0), 9) AS overlap FROM {_NEXT}")
def _(t):
    return t("documents").select("doc_id", F.round(T.overlap(T.tokens("text"), T.tokens(F.reverse("text"))), 9).alias("overlap"))


@query("set_token", f"SELECT doc_id, len(list_intersect(a, b)) AS shared FROM {_NEXT}")
def _(t):
    return t("documents").select("doc_id", F.size(F.array_intersect(T.tokens("text"), T.tokens(F.reverse("text")))).cast("long").alias("shared"))


@query("txt_non_letter_ratio", r"SELECT doc_id, round(1 - length(regexp_replace(title, '[^\p{L}]', '', 'g')) / nullif(length(title), 0), 9) AS ratio FROM titles")
def _(t):
    return t("titles").select("doc_id", F.round(T.non_letter_ratio("title"), 9).alias("ratio"))


_ECHO = r"""
    signs AS (
        SELECT doc_id, title, regexp_matches(title, 'https?://') AS is_url, regexp_matches(title, '%[0-9A-Fa-f]{2}') AS is_escape,
            NOT regexp_matches(title, '\s') AND length(title) > 25 AS is_long, regexp_matches(lower(title), '\.(html|htm|php|asp|aspx)$') AS is_file,
            coalesce(1 - length(regexp_replace(title, '[^\p{L}]', '', 'g')) / nullif(length(title), 0), 0) AS ratio
        FROM titles),
    echoes AS (
        SELECT *, is_url OR is_escape OR is_long::INT + is_file::INT + (ratio > 0.6)::INT >= 2 AS echo,
            CASE WHEN is_url THEN 'title contains a URL' WHEN is_escape THEN 'title contains a percent-escape' ELSE array_to_string(list_filter([
                CASE WHEN is_long THEN 'title has no whitespace and is longer than 25 chars' END, CASE WHEN is_file THEN 'title ends in a file extension' END,
                CASE WHEN ratio > 0.6 THEN 'title is ' || CAST(round(ratio * 100) AS INT) || '% non-letter characters' END], lambda x: x IS NOT NULL), '; ') END AS reasons
        FROM signs)"""


@query("echo_detect", f"WITH {_ECHO} SELECT doc_id, echo, reasons FROM echoes")
def _(t):
    return t("titles").select("doc_id", T.is_echo("title").alias("echo"), F.array_join(T.echo_reasons("title"), "; ").alias("reasons"))


@query("echo_scan", f"WITH {_ECHO} SELECT doc_id AS id, 'title' AS field, title AS value, reasons FROM echoes WHERE echo")
def _(t):
    return Q.echo_scan(t("titles"), "doc_id", ["title"]).select("id", "field", "value", F.array_join("reasons", "; ").alias("reasons"))


_BEST = """
    ranked AS (SELECT *, row_number() OVER w AS nr, lead(d) OVER w AS next FROM pairs WINDOW w AS (PARTITION BY q ORDER BY d, o)),
    best AS (SELECT q, o, d, next FROM ranked WHERE nr = 1 AND d < {floor})"""
_LABELS = f"""
    q AS (SELECT doc_id, len(tok) AS nq, unnest(tok) AS token FROM (SELECT doc_id, {_TOKENS.format(c='text')} AS tok FROM documents)),
    c AS (SELECT item_id, len(tok) AS nc, unnest(tok) AS token FROM (SELECT item_id, {_TOKENS.format(c='text')} AS tok FROM benchmark)),
    pairs AS (SELECT doc_id AS q, item_id AS o, 1 - count(*) / least(any_value(nq), any_value(nc)) AS d FROM q JOIN c USING (token) GROUP BY 1, 2),
    {_BEST.format(floor=0.6)}"""


@query("best_label", f"WITH {_LABELS} SELECT q AS doc_id, o AS item_id, round(d, 9) AS distance, round(coalesce(next, CASE WHEN (SELECT count(*) FROM benchmark) > 1 THEN 1.0 END), 9) AS runner_up FROM best")  # what shares no token has distance 1
def _(t):
    found = M.best_label(t("documents"), t("benchmark"), "doc_id", "text", "item_id", "text", floor=0.4)
    return found.select("doc_id", "item_id", F.round("distance", 9).alias("distance"), F.round("runner_up", 9).alias("runner_up"))


#: Customers and suppliers on a grid, some within reach of each other.
DERIVED["points"] = "SELECT c_custkey AS q, CAST(40 + (c_custkey % 97) * 0.01 AS DOUBLE) AS lat, CAST(10 + (c_custkey % 53) * 0.01 + 0.001 AS DOUBLE) AS lon FROM customer"
DERIVED["places"] = "SELECT s_suppkey AS o, CASE WHEN s_suppkey % 13 <> 5 THEN CAST(40 + (s_suppkey % 89) * 0.01 + 0.002 AS DOUBLE) END AS lat, CAST(10 + (s_suppkey % 61) * 0.01 AS DOUBLE) AS lon FROM supplier"
_GEO = f"""
    pairs AS (SELECT q, o, 2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2)))) AS d
        FROM points p, places c WHERE c.lat IS NOT NULL),
    {_BEST.format(floor=1500)}"""


@query("nearest_geo", f"WITH {_GEO} SELECT q, o, round(d, 3) AS distance, round(next, 3) AS runner_up, round(next - d, 3) AS margin, (SELECT count(*) FROM places WHERE lat IS NULL) AS skipped FROM best")
def _(t):
    """The twin compares every point with every place; the operator does not."""
    found = M.nearest_geo(t("points"), t("places"), "q", "o")
    rounded = lambda c: F.round(c, 3).alias(c)
    return found.select("q", "o", rounded("distance"), rounded("runner_up"), rounded("margin"), "skipped")


_LINES = "pairs AS (SELECT l_orderkey AS q, l_linenumber AS o, min(CASE WHEN l_quantity < 3 THEN NULL ELSE abs(l_quantity - 25) END) AS d FROM lineitem GROUP BY 1, 2)"


@query(
    "best_under",
    f"""WITH {_LINES}, ranked AS (SELECT *, row_number() OVER w AS nr, lead(d) OVER w AS next FROM pairs WHERE d IS NOT NULL WINDOW w AS (PARTITION BY q ORDER BY d, o)),
        skipped AS (SELECT q, count(*) FILTER (d IS NULL) AS skipped FROM pairs GROUP BY q)
        SELECT q, o, d, next AS runner_up, next - d AS margin, skipped FROM ranked JOIN skipped USING (q) WHERE nr = 1 AND d < 5""",
)
def _(t):
    d = F.when(F.col("l_quantity") >= 3, F.abs(F.col("l_quantity") - 25))
    pairs = t("lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("o")).agg(F.min(d).alias("d"))
    return M.best_under(pairs, "q", "d", "o", 5.0)


@query("top1_distance", f"WITH {_LINES} SELECT q, arg_min(o, struct_pack(d := d, o := o)) AS o FROM pairs WHERE d IS NOT NULL GROUP BY q")
def _(t):
    d = F.when(F.col("l_quantity") >= 3, F.abs(F.col("l_quantity") - 25))
    pairs = t("lineitem").groupBy(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("o")).agg(F.min(d).alias("d"))
    return M.nearest(pairs, "q", "d", "o")


_ASSESSED = """
    assessed AS (
        SELECT m.item_id, m.status, m.source_count, coalesce(s.stored_count, 0) AS stored_count,
            CASE WHEN s.stored_count IS NULL OR m.status <> 'ok' OR m.source_count <= 0 THEN NULL ELSE s.stored_count / m.source_count END AS ratio
        FROM measurements m LEFT JOIN stored_counts s USING (item_id)),
    judged AS (SELECT *, CASE WHEN ratio IS NULL THEN 'manual' WHEN ratio >= 0.8 THEN 'ok' ELSE 'undercoverage' END AS verdict FROM assessed)"""


@query("assess_all", f"WITH {_ASSESSED} SELECT item_id, stored_count, round(ratio, 9) AS ratio, verdict FROM judged")
def _(t):
    found = S.assess_all(t("measurements"), t("stored_counts"))
    return found.select("item_id", "stored_count", F.round("ratio", 9).alias("ratio"), "verdict")


@query("assess", f"WITH {_ASSESSED} SELECT item_id, verdict FROM judged WHERE stored_count > 0")
def _(t):
    rows = t("measurements").join(t("stored_counts"), "item_id")
    return rows.select("item_id", S.assess(F.col("status"), F.col("source_count"), F.col("stored_count"))["verdict"].alias("verdict"))


@query("scalar_summary", f"WITH {_ASSESSED} SELECT verdict, count(*) AS n FROM judged GROUP BY 1")
def _(t):
    return S.verdict_counts(S.assess_all(t("measurements"), t("stored_counts")))


DERIVED["claims"] = """
    SELECT o_orderkey AS id, CASE o_orderkey % 10
        WHEN 0 THEN '{"status": "ok", "source_count": "12"}'
        WHEN 1 THEN '{"status": "ok", "source_count": 1.5}'
        WHEN 2 THEN '{"status": "ok", "source_count": true}'
        WHEN 3 THEN '{"status": "ok", "source_count": null}'
        WHEN 4 THEN '{"status": "ok", "source_count": -1}'
        WHEN 5 THEN '{"status": "manual", "source_count": 3}'
        WHEN 6 THEN '{"status": "bogus"}'
        WHEN 7 THEN '{"source_count": 3}'
        WHEN 8 THEN '{"status": "ok"}'
        ELSE '{"item_id": "x", "status": "ok", "source_count": 4}' END AS payload,
        CASE WHEN o_orderkey % 20 = 8 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS item_id
    FROM orders"""


@query(
    "parse_measurement",
    """SELECT id, CASE WHEN item_id IS NULL AND id % 10 <> 9 THEN 'no item_id' WHEN id % 10 = 7 THEN 'no status' WHEN id % 10 = 5 THEN 'derived status' WHEN id % 10 = 6 THEN 'unknown status'
         WHEN id % 10 <= 3 THEN 'source_count must be an integer' WHEN id % 10 = 4 THEN 'source_count is negative' END AS error FROM claims""",
)
def _(t):
    return t("claims").select("id", S.measurement_error("payload", F.col("item_id")).alias("error"))


_STATUS = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'manual' WHEN 2 THEN 'bogus' END AS status FROM orders"
DERIVED["statuses"] = _STATUS


@query(
    "vocab_valid",
    """SELECT id, CASE WHEN status = 'bogus' THEN 'at: unknown coverage_status ''bogus''; allowed: access_blocked, ok, unparseable'
         WHEN status = 'manual' THEN 'at: ''manual'' is derived by the caller, not reported by an agent; allowed: access_blocked, ok, unparseable' END AS error FROM statuses""",
)
def _(t):
    return t("statuses").select("id", S.vocabulary_error("status", "coverage_status", True, "at").alias("error"))


@query("vocab_filter", "SELECT id, coalesce(status IN ('ok', 'unparseable', 'access_blocked'), false) AS offered, coalesce(status IN ('manual', 'undercoverage'), false) AS derived FROM statuses")
def _(t):
    inside = lambda values: F.coalesce(F.col("status").isin(values), F.lit(False))
    return t("statuses").select("id", inside(K.offered("coverage_status")).alias("offered"), inside(K.derived("coverage_status")).alias("derived"))


@query(
    "verdict_classify",
    """SELECT id, CASE WHEN v NOT IN ('confirmed', 'refuted', 'uncertain') THEN 'allowed: confirmed, refuted, uncertain' END AS error
       FROM (SELECT id, CASE id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'uncertain' ELSE 'maybe' END AS v FROM statuses)""",
)
def _(t):
    from ..operators import workflows as W

    v = F.expr("case id % 3 when 0 then 'confirmed' when 1 then 'uncertain' else 'maybe' end")
    return t("statuses").select("id", W.verdict_error(v).alias("error"))


@query("tie_break", "SELECT id, id % 3 = 1 AS keep_original, id % 3 = 1 AS flag_for_human FROM statuses")
def _(t):
    v = F.expr("case id % 3 when 0 then 'confirmed' when 1 then 'uncertain' else 'refuted' end")
    return t("statuses").select("id", S.tie_break(v).alias("b")).select("id", "b.*")


@query("const_get", f"SELECT o_orderkey AS id, count(*) >= {K.BATCH_SIZE} AS full_batch, count(*) >= 7 AS fallback FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    """Fixed values by name; an unknown name without a default would raise before anything runs."""
    n = F.count(F.lit(1))
    rows = t("lineitem").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy(F.col("l_orderkey").alias("id"))
    return rows.agg((n >= K.get("BATCH_SIZE")).alias("full_batch"), (n >= K.get("NO_SUCH_VALUE", 7)).alias("fallback"))
