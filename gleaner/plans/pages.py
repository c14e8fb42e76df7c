"""Queries on pages and addresses."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import fanout as O
from ..operators import linkstate as L
from ..operators import media as M
from ..operators import quality as Q
from ..operators import robots as R
from ..operators.ordering import ordered
from ..sources import readers, store
from .base import DERIVED, query

#: Pages of which some are error pages, some lack a title, and some are challenges.
DERIVED["made_pages"] = """
    SELECT page_id, url, CASE
        WHEN page_id % 10 = 3 THEN '<html><head><title>Notice</title></head><body><p>Sorry, Access Denied for ' || CAST(page_id AS STRING) || '.</p></body></html>'
        WHEN page_id % 10 = 5 THEN html || '<p>an error occurred</p><img src="/i/error.png">'
        WHEN page_id % 10 = 7 THEN replace(replace(html, '<title', '<xtitle'), '</title', '</xtitle')
        WHEN page_id % 10 = 9 THEN '<html><head><title> Just a Moment... </title></head><body>Wait &amp; see &lt;' || CAST(page_id AS STRING) || '&gt;</body></html>'
        WHEN page_id % 10 = 1 THEN replace(html, '</head>', '<script type="application/ld+json">' || CASE WHEN page_id % 20 = 1 THEN '{"id": 1}' ELSE '{"id": ' END || '</script></head>')
        ELSE html END AS html
    FROM pages"""

#: Addresses of several kinds.
DERIVED["links"] = """
    SELECT page_id, page_id AS ordinal, CASE
        WHEN page_id % 12 = 1 THEN replace(url, '://', '://user:pw@') || '.PDF?x=1'
        WHEN page_id % 12 = 2 THEN url || '/logo.png'
        WHEN page_id % 12 = 3 THEN 'https://www.googletagmanager.com/gtm.js?id=' || CAST(page_id AS STRING)
        WHEN page_id % 12 = 4 THEN '/api/items/' || CAST(page_id AS STRING)
        WHEN page_id % 12 = 5 THEN 'https://Cdn.Example.com:8080/media/' || CAST(page_id % 17 AS STRING) || '/crop_square.jpg'
        WHEN page_id % 12 = 6 THEN 'https://cdn.example.com/media/' || CAST(page_id % 17 AS STRING) || '/full.jpg'
        WHEN page_id % 12 = 7 THEN 'https://host.example.org/api/v1/list?page=' || CAST(page_id AS STRING)
        ELSE url END AS url
    FROM pages"""

#: What was known about addresses, and what a probe of them gave.
DERIVED["link_states"] = """
    SELECT url, page_id,
        CASE page_id % 12 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN -1 WHEN 3 THEN 503 WHEN 4 THEN 302 ELSE 200 END AS http_status,
        CASE WHEN page_id % 8 = 0 THEN 'fetch_js' WHEN page_id % 8 = 1 THEN 'guess' END AS verified_via,
        CASE page_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'wrong_topic' WHEN 2 THEN 'bogus' ELSE 'js_only' END AS content_status,
        page_id % 7 = 0 AS has_extra
    FROM pages WHERE url NOT IN (SELECT url FROM pages GROUP BY url HAVING count(*) > 1)"""
DERIVED["probes"] = """
    SELECT url, page_id,
        CASE page_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 405 WHEN 2 THEN 404 WHEN 3 THEN NULL WHEN 4 THEN 503 ELSE NULL END AS head,
        CASE WHEN page_id % 6 = 3 THEN 200 END AS head_relaxed,
        CASE WHEN page_id % 6 = 3 THEN 'certificate verify failed' WHEN page_id % 6 = 5 THEN 'timed out' END AS head_error,
        CASE page_id % 6 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 4 THEN NULL ELSE 500 END AS get_status
    FROM pages"""

DERIVED["robots_files"] = """
    SELECT origin, CASE
        WHEN length(origin) % 4 = 0 THEN NULL
        WHEN length(origin) % 4 = 1 THEN 'User-agent: *' || chr(10) || 'Disallow: /en/' || chr(10) || 'Allow: /en/7' || chr(10) || 'Crawl-delay: 2' || chr(10) || '# end' || chr(10) || 'Sitemap: ' || origin || '/map.xml'
        WHEN length(origin) % 4 = 2 THEN 'user-agent: *' || chr(10) || 'disallow: /' || chr(10) || chr(10) || 'User-Agent: gleanbot' || chr(10) || 'User-Agent: other' || chr(10) || 'Disallow: /*.html$' || chr(10) || 'Disallow:' || chr(10) || 'Crawl-delay: x'
        ELSE 'Disallow: /early' || chr(10) || 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || 'Disallow: page=2 # paging' END AS robots
    FROM (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS origin FROM pages) o"""

_TEXT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
_TITLE = "CASE WHEN regexp_matches(html, '(?is)<title[^>]*>(.*?)</title>') THEN trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) END"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)', 1))"
_SOFT = f"""
    seen AS (SELECT *, {_TEXT} AS t, {_TITLE} AS ti FROM made_pages),
    judged AS (
        SELECT page_id, url, length(t) AS text_chars,
            CASE {' '.join(f"WHEN contains(lower(t), '{m}') THEN '{m}'" for m in K.markers('soft_error_markers'))} END AS phrase,
            length(t) < 500 AS short, coalesce(ti, '') = '' AS untitled,
            regexp_matches(html, '(?i)<img[^>]+(error|warning)\\.(png|gif|svg)') AS icon
        FROM seen),
    soft AS (
        SELECT *, (phrase IS NOT NULL AND text_chars < 2000) OR
            short::INT + untitled::INT + (phrase IS NOT NULL)::INT + icon::INT >= 2 AS suspect
        FROM judged)"""


@query("html_visible_text", f"SELECT page_id, {_TEXT} AS visible FROM made_pages")
def _(t):
    return t("made_pages").select("page_id", H.visible_text("html").alias("visible"))


@query("html_title", f"SELECT page_id, {_TITLE} AS title FROM made_pages")
def _(t):
    return t("made_pages").select("page_id", H.title("html").alias("title"))


@query(
    "html_ldjson",
    r"""SELECT page_id, len(list_filter(regexp_extract_all(html, '(?is)<script[^>]+type=["'']application/ld\+json["''][^>]*>(.*?)</script>', 1), lambda x: json_valid(trim(x)))) AS n_blocks
        FROM made_pages""",
)
def _(t):
    return t("made_pages").select("page_id", F.size(H.ld_json("html")).cast("long").alias("n_blocks"))


_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _decoded(c: str) -> str:
    """SQL that replaces the character references that the derived pages hold, by one pass over the text."""
    code = "CASE WHEN k ILIKE '#x%' THEN try_cast('0x' || k[3:] AS BIGINT) WHEN k LIKE '#%' THEN try_cast(k[2:] AS BIGINT) END"
    named = " ".join(f"WHEN lower(k) = '{n}' THEN '{x.replace(chr(39), chr(39) * 2)}'" for n, x in H.NAMED.items())
    key = "regexp_extract(x, '(?i)&(#x?[0-9a-f]+|[a-z]+);', 1)"
    one = f"CASE {named} WHEN {code} BETWEEN 1 AND 1114111 THEN chr(({code})::INT) ELSE '&' || k || ';' END".replace("k ", f"{key} ").replace("k[", f"{key}[").replace("(k)", f"({key})")
    return f"array_to_string(list_transform(regexp_extract_all({c}, '(?is)&(?:#x?[0-9a-f]+|[a-z]+);|[^&]+|&'), lambda x: CASE WHEN regexp_matches(x, '(?i)^&(#x?[0-9a-f]+|[a-z]+);$') THEN {one} ELSE x END), '')"


_BARE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'),
    '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6])>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"""
_LINES = rf"""
    split AS (SELECT page_id, generate_subscripts(l, 1) AS nr, unnest(l) AS line FROM (SELECT page_id, string_split({_BARE}, chr(10)) AS l FROM entity_pages)),
    lines AS (SELECT page_id, nr, regexp_replace(regexp_replace({_decoded('line')}, '[ \t\x{{00A0}}]+', ' ', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS line FROM split),
    texts AS (SELECT page_id, count(*) FILTER (line <> '') AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (line <> ''), '') AS lines FROM lines GROUP BY page_id)"""

#: Pages with character references of every kind in their text and attributes, and odd attributes.
DERIVED["entity_pages"] = """
    SELECT page_id, url, replace(replace(html, '</body>', '<p>a &amp; b&nbsp;&#128512; &#x1F600; &#65533; &#0000065; &#38;amp; &bogus; &AMP; <b>x</b> &lt;i&gt;</p><a href="">none</a><a class="k" href="/q?a&amp;b=' || CAST(page_id AS STRING) || '">q</a></body>'), '<title>', '<title>&quot;A&#38;B&quot; ') AS html
    FROM made_pages"""


@query("html_title_decoded", f"SELECT page_id, {_decoded('title')} AS title FROM (SELECT page_id, {_TITLE} AS title FROM entity_pages)")
def _(t):
    return t("entity_pages").select("page_id", H.title_decoded("html").alias("title"))


@query("html_text_lines", f"WITH {_LINES} SELECT page_id, n_lines, sha256(lines) AS sha FROM texts")
def _(t):
    lines = H.text_lines("html")
    return t("entity_pages").select("page_id", F.size(lines).cast("long").alias("n_lines"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha"))


@query("html_parse", f"WITH {_LINES} SELECT page_id, n_lines AS line_count, length(lines) AS text_chars FROM texts")
def _(t):
    s = H.page_summary("html")
    return t("entity_pages").select("page_id", s["line_count"].cast("long").alias("line_count"), s["text_chars"].cast("long").alias("text_chars"))


@query(
    "html_slice",
    """WITH a AS (SELECT page_id, html, strpos(lower(html), '<article>') AS begins FROM made_pages),
       b AS (SELECT page_id, begins, substr(html, begins) AS rest FROM a)
       SELECT page_id, CASE WHEN begins > 0 THEN CASE WHEN strpos(lower(rest), '</article>') > 1 THEN substr(rest, 1, strpos(lower(rest), '</article>') - 1) ELSE rest END END AS part FROM b""",
)
def _(t):
    return t("made_pages").select("page_id", H.slice_between("html", "<ARTICLE>", "</article>").alias("part"))


@query(
    "html_slice_pattern",
    r"""SELECT page_id, nullif(regexp_extract(html, '(?s)(<h[1-6][^>]*>.*?)(</h[1-6]>|$)', 1), '') AS part FROM made_pages""",
)
def _(t):
    return t("made_pages").select("page_id", H.slice_between("html", "<h[1-6][^>]*>", "</h[1-6]>", pattern=True).alias("part"))


_HREF = f"""SELECT page_id, generate_subscripts(a, 1) AS nr, unnest(a) AS tag FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*>') AS a FROM entity_pages)"""


@query(
    "html_attrs",
    rf"""WITH tags AS ({_HREF}), found AS (SELECT page_id, nr, regexp_extract(tag, '(?i)href=["'']([^"'']+)["'']', 1) AS v FROM tags)
        SELECT p.page_id, coalesce(string_agg({_decoded('v')}, ' ' ORDER BY nr) FILTER (v <> ''), '') AS hrefs FROM entity_pages p LEFT JOIN found f ON f.page_id = p.page_id GROUP BY 1""",
)
def _(t):
    return t("entity_pages").select("page_id", F.array_join(H.attributes("html", "a", "href"), " ").alias("hrefs"))


@query(
    "soft_error",
    f"""WITH {_SOFT}
        SELECT page_id, suspect, text_chars, array_to_string(list_filter([
            CASE WHEN short THEN 'only ' || text_chars || ' chars of visible text' END, CASE WHEN untitled THEN 'no <title>' END,
            CASE WHEN phrase IS NOT NULL THEN 'error phrase: ''' || phrase || '''' END, CASE WHEN icon THEN 'error icon' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM soft""",
)
def _(t):
    found = Q.soft_errors(t("made_pages"))
    return found.select("page_id", "suspect", F.col("text_chars").cast("long").alias("text_chars"), F.array_join("reasons", "; ").alias("reasons"))


@query("soft_count", f"WITH {_SOFT} SELECT count(*) AS pages, count(*) FILTER (suspect) AS suspects FROM soft")
def _(t):
    return Q.soft_errors(t("made_pages")).agg(F.count(F.lit(1)).alias("pages"), F.count_if("suspect").alias("suspects"))


@query(
    "soft_error_by_host",
    f"""WITH {_SOFT} SELECT {_HOST} AS host, count(*) AS pages, count(*) FILTER (suspect) AS suspects, min(text_chars) AS min_chars, round(avg(text_chars), 4) AS avg_chars
        FROM soft GROUP BY 1""",
)
def _(t):
    found = Q.soft_errors(t("made_pages")).groupBy(U.host("url").alias("host"))
    return found.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("suspect").alias("suspects"),
        F.min("text_chars").cast("long").alias("min_chars"),
        F.round(F.avg("text_chars"), 4).alias("avg_chars"),
    )


@query(
    "challenge_body",
    f"SELECT page_id, {' OR '.join(f"contains(lower(substr(html, 1, 4000)), '{m}')" for m in K.markers('challenge_markers'))} AS challenged FROM made_pages",
)
def _(t):
    return t("made_pages").select("page_id", T.is_challenge_body("html").alias("challenged"))


@query("challenge_title", f"SELECT page_id, contains(lower(coalesce({_TITLE}, '')), 'just a moment') AS challenged FROM made_pages")
def _(t):
    return t("made_pages").select("page_id", T.is_challenge_title(H.title("html")).alias("challenged"))


@query("body_floor", f"SELECT page_id, length({_TEXT}) > 2000 AS full_page FROM made_pages")
def _(t):
    return t("made_pages").select("page_id", (F.length(H.visible_text("html")) > K.BODY_FLOOR).alias("full_page"))


@query(
    "loc_markers",
    f"SELECT page_id, {' OR '.join(f"contains(lower(html), '{m}')" for m in K.markers('soft_error_markers', ('en', 'fr', 'de')))} AS marked FROM made_pages",
)
def _(t):
    return t("made_pages").select("page_id", T.holds_any(F.lower("html"), K.markers("soft_error_markers", ("en", "fr", "de"))).alias("marked"))


@query("url_host", f"SELECT page_id, {_HOST} AS host FROM links")
def _(t):
    return t("links").select("page_id", U.host("url").alias("host"))


@query("url_timeout", "SELECT page_id, CASE WHEN lower(split_part(url, '?', 1)) LIKE '%.pdf' THEN 30 ELSE 10 END AS timeout_s FROM links")
def _(t):
    return t("links").select("page_id", U.timeout_s("url").alias("timeout_s"))


_PATH = r"""CASE WHEN query = '' THEN path ELSE path || '?' || query END"""
_PARTS = r"""rest AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS r FROM {src}),
    parts AS (SELECT page_id, url, coalesce(nullif(split_part(r, '?', 1), ''), '/') AS path, CASE WHEN contains(r, '?') THEN substr(r, strpos(r, '?') + 1) ELSE '' END AS query FROM rest)"""


@query("url_robots_path", f"WITH {_PARTS.format(src='links')} SELECT page_id, {_PATH} AS path FROM parts")
def _(t):
    return t("links").select("page_id", U.robots_path("url").alias("path"))


@query("url_is_asset", f"SELECT page_id, regexp_matches(url, '(?i){K.ASSET}') AS asset FROM links")
def _(t):
    return t("links").select("page_id", U.is_asset("url").alias("asset"))


@query("url_is_third_party", f"SELECT page_id, regexp_matches(url, '(?i){K.THIRD_PARTY}') AS third_party FROM links")
def _(t):
    return t("links").select("page_id", U.is_third_party("url").alias("third_party"))


@query("url_is_avatar", "SELECT page_id, contains(url, 'crop_square') AS avatar FROM links")
def _(t):
    return t("links").select("page_id", U.is_avatar("url").alias("avatar"))


@query("url_is_relative", "SELECT page_id, NOT regexp_matches(url, '(?i)^[a-z]+://') AS relative FROM links")
def _(t):
    return t("links").select("page_id", U.is_relative("url").alias("relative"))


@query("url_media_id", "SELECT page_id, nullif(regexp_extract(url, '/media/([0-9]+)/', 1), '') AS media_id FROM links")
def _(t):
    return t("links").select("page_id", U.media_id("url", "/media/([0-9]+)/").alias("media_id"))


@query("url_hires", "SELECT page_id, 'https://cdn.example.com/' || page_id || '_1400_{id}.jpg' AS hires FROM links")
def _(t):
    return t("links").select("page_id", U.hires(F.lit("https://cdn.example.com/{id}_{w}_{id}.jpg"), F.col("page_id").cast("string")).alias("hires"))


@query("url_encode")
def _(t):
    return t("links").select("page_id", U.encode_url(F.concat("url", F.lit("/é ü?q=ñ"))).alias("encoded"))


@query(
    "resolve_pin",
    r"""SELECT page_id, host, CASE WHEN regexp_matches(a, '^[0-9.]+$') THEN a WHEN contains(a, ':') THEN '[' || a || ']' END AS address FROM (
        SELECT page_id, regexp_extract(url, '//([^/:]*)', 1) AS host, CASE page_id % 3 WHEN 0 THEN '10.0.0.' || page_id % 250 WHEN 1 THEN '::1' ELSE 'name' END AS a FROM pages)""",
)
def _(t):
    entry = "concat(regexp_extract(url, '//([^/:]*)', 1), ':', case page_id % 3 when 0 then concat('10.0.0.', page_id % 250) when 1 then '[::1]' else 'name' end)"
    return t("pages").select("page_id", U.pin(F.expr(entry)).alias("p")).select("page_id", "p.host", "p.address")


@query("host_buckets", f"SELECT host, (nr - 1) // 50 AS part, count(*) AS n, string_agg(url, ' ' ORDER BY ordinal) AS urls FROM (SELECT {_HOST} AS host, ordinal, url, row_number() OVER (PARTITION BY {_HOST} ORDER BY ordinal) AS nr FROM links) GROUP BY 1, 2")
def _(t):
    """A host's addresses in order, in lists of fifty."""
    return L.host_buckets(t("links"), "ordinal", 50).select("host", "part", "n", F.array_join("urls", " ").alias("urls"))


@query(
    "host_serial",
    f"""WITH RECURSIVE hosted AS (SELECT page_id, {_HOST} AS host, ordinal FROM links),
        queues AS (SELECT host, n, row_number() OVER (ORDER BY n DESC, seen, host) AS nr FROM (SELECT host, count(*) AS n, min(ordinal) AS seen FROM hosted GROUP BY host)),
        steps AS (SELECT CAST(0 AS BIGINT) AS nr, CAST(0 AS DOUBLE) AS began, list_transform(range(3), lambda x: CAST(0 AS DOUBLE)) AS free
            UNION ALL SELECT q.nr, list_min(s.free), list_concat(list_slice(s.free, 1, list_position(s.free, list_min(s.free)) - 1), [list_min(s.free) + q.n - 1], list_slice(s.free, list_position(s.free, list_min(s.free)) + 1, 3))
            FROM steps s JOIN queues q ON q.nr = s.nr + 1)
        SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY ordinal) - 1 AS slot, began + row_number() OVER (PARTITION BY host ORDER BY ordinal) - 1 AS starts_s
        FROM hosted JOIN queues USING (host) JOIN steps USING (nr)""",
)
def _(t):
    """At most three hosts at once, so that some wait."""
    return L.host_plan(t("links"), "ordinal", max_hosts=3).select("page_id", "host", F.col("slot").cast("long").alias("slot"), "starts_s")


@query("host_makespan", f"WITH per AS (SELECT {_HOST} AS host, count(*) AS n FROM links GROUP BY 1) SELECT count(*) AS hosts, CAST(max(n) - 1 AS DOUBLE) AS longest_s, CAST(sum(n - 1) AS DOUBLE) AS one_by_one_s FROM per")
def _(t):
    """With a slot for each host the longest queue is the makespan; with one slot all queues follow each other."""
    alone = L.host_plan(t("links"), "ordinal", max_hosts=1).agg(F.max("starts_s").alias("one_by_one_s"))
    wide = L.host_plan(t("links"), "ordinal", max_hosts=1 << 20).agg(F.countDistinct("host").alias("hosts"), F.max("starts_s").alias("longest_s"))
    return wide.crossJoin(alone)  # one row each


@query("live_count", "SELECT count(*) FILTER (http_status IN (200, 301, 302, 303, 307, 308)) AS live, count(*) AS total FROM link_states")
def _(t):
    return t("link_states").agg(F.count_if(L.is_live("http_status")).alias("live"), F.count(F.lit(1)).alias("total"))


@query("is_live", "SELECT url, http_status IN (200, 301, 302, 303, 307, 308) AS live FROM link_states")
def _(t):
    return t("link_states").select("url", L.is_live("http_status").alias("live"))


@query("is_sticky", "SELECT url, coalesce(verified_via = 'fetch_js', false) AND http_status IN (200, 301, 302, 303, 307, 308) AS sticky FROM link_states")
def _(t):
    return t("link_states").select("url", L.is_sticky("verified_via", "http_status").alias("sticky"))


_LADDER = """CASE WHEN h IN (200, 301, 302, 303, 307, 308) THEN h ELSE coalesce(get_status, -1) END"""
_HEAD = "(SELECT *, coalesce(head, CASE WHEN contains(coalesce(head_error, ''), 'certificate') THEN head_relaxed END, -1) AS h FROM probes)"


@query("tls_error", "SELECT page_id, contains(lower(coalesce(head_error, '')), 'certificate') OR contains(lower(coalesce(head_error, '')), 'ssl') AS tls FROM probes")
def _(t):
    return t("probes").select("page_id", L.is_tls_error("head_error").alias("tls"))


@query("probe_ladder", f"SELECT page_id, {_LADDER} AS status FROM {_HEAD}")
def _(t):
    none = F.lit(None).cast("int")
    status = L.ladder(F.col("head"), F.col("head_relaxed"), L.is_tls_error("head_error"), F.col("get_status"), none, F.lit(False))
    return t("probes").select("page_id", status.alias("status"))


@query(
    "resolve_status",
    f"""SELECT s.url, CASE WHEN sticky THEN http_status ELSE coalesce(p.status, -1) END AS status, NOT sticky AS probed
        FROM (SELECT *, coalesce(verified_via = 'fetch_js', false) AND http_status IN (200, 301, 302, 303, 307, 308) AS sticky FROM link_states) s
        LEFT JOIN (SELECT url, {_LADDER} AS status FROM {_HEAD}) p USING (url)""",
)
def _(t):
    none = F.lit(None).cast("int")
    status = L.ladder(F.col("head"), F.col("head_relaxed"), L.is_tls_error("head_error"), F.col("get_status"), none, F.lit(False))
    return L.resolve(t("link_states"), t("probes").select("url", status.alias("status")))


@query(
    "sticky_split",
    """SELECT url, CASE WHEN coalesce(verified_via = 'fetch_js', false) AND http_status IN (200, 301, 302, 303, 307, 308) THEN 'sticky' ELSE 'probe' END AS part FROM link_states""",
)
def _(t):
    states = t("link_states").withColumn("sticky", L.is_sticky("verified_via", "http_status"))
    sticky = states.where("sticky").select("url", F.lit("sticky").alias("part"))
    return sticky.unionByName(states.where("not sticky").select("url", F.lit("probe").alias("part")))


@query(
    "linkstate_merge",
    """SELECT coalesce(s.url, n.url) AS url, coalesce(n.http_status, s.http_status) AS http_status, coalesce(n.last_checked, s.last_checked) AS last_checked, s.verified_via
       FROM (SELECT url, http_status, '2024-01-01' AS last_checked, verified_via FROM link_states WHERE page_id % 4 <> 0) s
       FULL JOIN (SELECT url, CAST(200 + page_id % 3 AS INT) AS http_status, '2024-02-02' AS last_checked FROM link_states WHERE page_id % 3 = 0) n ON s.url = n.url""",
)
def _(t):
    states = t("link_states")
    old = states.where("page_id % 4 <> 0").select("url", "http_status", F.lit("2024-01-01").alias("last_checked"), "verified_via")
    new = states.where("page_id % 3 = 0").select("url", F.expr("cast(200 + page_id % 3 as int)").alias("http_status"), F.lit("2024-02-02").alias("last_checked"))
    return L.merge_http(old, new)


@query(
    "linkstate_verdicts",
    """SELECT coalesce(s.url, n.url) AS url, CASE WHEN n.url IS NOT NULL THEN 'ok' WHEN s.odd THEN s.content_status END AS facts, CASE WHEN s.odd IS NOT NULL AND NOT s.odd THEN s.content_status END AS price
       FROM (SELECT url, page_id % 2 = 1 AS odd, content_status FROM link_states WHERE page_id % 4 <> 0) s
       FULL JOIN (SELECT url FROM link_states WHERE page_id % 3 = 0) n ON s.url = n.url""",
)
def _(t):
    states = t("link_states")
    kind = F.expr("case when page_id % 2 = 1 then 'facts' else 'price' end")
    old = states.where("page_id % 4 <> 0").select("url", F.create_map(kind, F.col("content_status")).alias("verdicts"))
    new = states.where("page_id % 3 = 0").select("url", F.lit("facts").alias("kind"), F.lit("ok").alias("verdict"))
    return L.merge_verdicts(old, new).select("url", F.try_element_at("verdicts", F.lit("facts")).alias("facts"), F.try_element_at("verdicts", F.lit("price")).alias("price"))


@query(
    "schema_errors",
    """SELECT url, problem FROM (
         SELECT url, CASE WHEN has_extra THEN 'unknown top-level keys extra' END AS problem FROM link_states
         UNION ALL SELECT url, CASE WHEN verified_via <> 'fetch_js' THEN 'unknown verified_via ' || verified_via END FROM link_states
         UNION ALL SELECT url, CASE WHEN page_id % 9 = 0 THEN '[facts] unknown verdict keys who' END FROM link_states
         UNION ALL SELECT url, CASE WHEN content_status = 'bogus' THEN '[facts] unknown content_status bogus' END FROM link_states)
       WHERE problem IS NOT NULL""",
)
def _(t):
    verdict = F.struct(F.expr("case when page_id % 9 = 0 then array('content_status', 'who') else array('content_status') end").alias("keys"), "content_status")
    keys = F.expr("case when has_extra then array('http_status', 'extra') else array('http_status') end").alias("keys")
    return L.schema_problems(t("link_states").select("url", keys, "verified_via", F.create_map(F.lit("facts"), verdict).alias("verdicts"))).select("url", "problem")


_AGENT = "gleanbot/1.0"
_RULES = r"""
    raw AS (SELECT origin, trim(split_part(line, '#', 1)) AS line, pos FROM (
        SELECT origin, unnest(string_split(robots, chr(10))) AS line, generate_subscripts(string_split(robots, chr(10)), 1) - 1 AS pos FROM robots_files WHERE robots IS NOT NULL)),
    said AS (SELECT origin, pos, lower(trim(split_part(line, ':', 1))) AS field, trim(substr(line, strpos(line, ':') + 1)) AS value FROM raw WHERE contains(line, ':')),
    opened AS (SELECT *, (field = 'user-agent' AND coalesce(lag(field) OVER w <> 'user-agent', true))::INT AS o FROM said WINDOW w AS (PARTITION BY origin ORDER BY pos)),
    grouped AS (SELECT *, sum(o) OVER (PARTITION BY origin ORDER BY pos) AS grp FROM opened),
    agents AS (SELECT DISTINCT origin, grp, value AS agent FROM grouped WHERE field = 'user-agent'),
    norm AS (
        SELECT g.origin, a.agent, g.pos AS seq, g.field = 'allow' AS allow, g.value AS pattern, length(g.value) AS length,
            CASE WHEN starts_with(g.value, '/') OR starts_with(g.value, '*') THEN g.value ELSE '*' || g.value END AS p
        FROM grouped g JOIN agents a ON g.origin = a.origin AND g.grp = a.grp WHERE field IN ('allow', 'disallow') AND NOT (field = 'disallow' AND value = '')),
    rules AS (
        SELECT *, '^' || replace(regexp_replace(CASE WHEN p LIKE '%$' THEN p[:-2] ELSE p END, '([^A-Za-z0-9*/_-])', '\\\1', 'g'), '*', '.*') || CASE WHEN p LIKE '%$' THEN '$' ELSE '' END AS regex
        FROM norm)"""


@query("robots_parse", f"WITH {_RULES} SELECT origin, agent, seq, allow, pattern, length FROM rules")
def _(t):
    found = R.rules(t("robots_files"))
    return found.select("origin", "agent", F.col("seq").cast("long").alias("seq"), "allow", "pattern", F.col("length").cast("long").alias("length"))


@query("robots_pattern", f"WITH {_RULES} SELECT origin, agent, seq, regex FROM rules")
def _(t):
    return R.rules(t("robots_files")).select("origin", "agent", F.col("seq").cast("long").alias("seq"), "regex")


_CHOSEN = f"""{_RULES},
    chosen AS (SELECT origin, max(struct_pack(named := (agent <> '*')::INT, n := length(agent), a := agent)).a AS agent FROM agents
        WHERE agent = '*' OR contains('{_AGENT}', lower(agent)) GROUP BY origin)"""


@query("robots_agent", f"WITH {_CHOSEN} SELECT origin, agent FROM chosen")
def _(t):
    return R.chosen_agent(R.agents(t("robots_files")), _AGENT)


@query(
    "robots_delay",
    f"""WITH {_CHOSEN},
        delays AS (SELECT origin, grp, try_cast(value AS DOUBLE) AS d, pos FROM grouped WHERE field = 'crawl-delay' AND try_cast(value AS DOUBLE) IS NOT NULL)
        SELECT c.origin, c.agent, arg_max(d.d, d.pos) AS crawl_delay FROM chosen c JOIN agents a ON a.origin = c.origin AND a.agent = c.agent
        LEFT JOIN delays d ON d.origin = a.origin AND d.grp = a.grp GROUP BY 1, 2""",
)
def _(t):
    named = R.agents(t("robots_files"))
    return named.join(R.chosen_agent(named, _AGENT), ["origin", "agent"])


_ALLOWED = f"""{_CHOSEN}, {_PARTS.format(src='pages')},
    paths AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS origin, {_PATH} AS path FROM parts),
    best AS (SELECT p.page_id, max(struct_pack(l := r.length, a := r.allow::INT)).a = 1 AS allow FROM paths p JOIN rules r ON r.origin = p.origin
        JOIN chosen c ON c.origin = r.origin AND c.agent = r.agent WHERE regexp_matches(p.path, r.regex) GROUP BY 1),
    decided AS (SELECT p.page_id, p.origin, f.robots IS NOT NULL AND coalesce(b.allow, true) AS allowed FROM paths p LEFT JOIN best b USING (page_id) LEFT JOIN robots_files f ON f.origin = p.origin)"""


def _robots(t):
    return R.allowed(t("pages").withColumn("origin", U.origin("url")), t("robots_files"), _AGENT)


@query("robots_allowed", f"WITH {_ALLOWED} SELECT page_id, allowed FROM decided")
def _(t):
    return _robots(t).select("page_id", "allowed")


@query("robots_filter", f"WITH {_ALLOWED} SELECT origin, count(*) FILTER (allowed) AS allowed, count(*) FILTER (NOT allowed) AS blocked FROM decided GROUP BY 1")
def _(t):
    return _robots(t).groupBy("origin").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("blocked"))


@query(
    "src_robots_txt",
    r"""SELECT o.origin, f.robots IS NOT NULL AS reachable, length(f.robots) AS chars FROM (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS origin FROM pages) o
        LEFT JOIN (SELECT * FROM robots_files WHERE length(origin) % 5 > 0) f ON f.origin = o.origin""",
)
def _(t):
    """Origins of all pages; some have no file, some a file that could not be read."""
    origins = t("pages").select(U.origin("url").alias("origin"))
    found = R.load(origins, t("robots_files").where("length(origin) % 5 > 0"))
    return found.select("origin", "reachable", F.length("robots").cast("long").alias("chars"))


#: Sitemap files: an index to every ten maps, maps to pages.
DERIVED["sitemap_files"] = """
    SELECT 'root' AS sitemap, 0 AS nr, '<?xml version="1.0"?><sitemapindex><sitemap><loc> index0 </loc></sitemap><sitemap><loc>index1</loc></sitemap></sitemapindex>' AS xml FROM (SELECT 1 AS one) u
    UNION ALL
    SELECT 'index' || CAST(page_id % 2 AS STRING) AS sitemap, page_id AS nr, '<sitemapindex><sitemap><loc>map' || CAST(page_id AS STRING) || '</loc></sitemap><sitemap><loc></loc></sitemap></sitemapindex>' AS xml FROM pages
    UNION ALL
    SELECT 'map' || CAST(page_id AS STRING) AS sitemap, page_id AS nr, '<urlset><url><loc>' || url || '</loc></url><url><loc>' || url || '/more</loc></url></urlset>' AS xml FROM pages WHERE page_id % 3 > 0"""

_MAPS = "entries AS (SELECT sitemap, nr, contains(xml, '<sitemapindex>') AS is_index, unnest(list_filter(list_transform(regexp_extract_all(xml, '(?s)<loc>(.*?)</loc>', 1), lambda x: trim(x)), lambda x: x <> '')) AS loc FROM sitemap_files)"


@query("src_sitemap_xml", f"WITH {_MAPS} SELECT sitemap, is_index, loc FROM entries")
def _(t):
    return R.sitemap_entries(t("sitemap_files")).select("sitemap", "is_index", "loc")


_WALK = f"""{_MAPS},
    kids AS (SELECT loc, min(CASE sitemap WHEN 'index0' THEN 1 ELSE 2 END) AS parent FROM entries WHERE sitemap LIKE 'index%' AND is_index GROUP BY loc),
    walked AS (SELECT 'root' AS sitemap, 0 AS level, 1 AS nr UNION ALL SELECT 'index0', 1, 2 UNION ALL SELECT 'index1', 1, 3
        UNION ALL SELECT loc, 2, 3 + row_number() OVER (ORDER BY parent, loc) FROM kids)"""


def _walk(t, limit=None):
    entries = R.sitemap_entries(t("sitemap_files"))
    return R.sitemap_walk(entries, entries.where("sitemap = 'root'").select("sitemap").distinct(), limit)


@query("sitemap_walk", f"WITH {_WALK} SELECT sitemap, level FROM walked")
def _(t):
    return _walk(t).select("sitemap", "level")


@query("fetch_cap", f"WITH {_WALK} SELECT sitemap, level, nr <= 40 AS fetched FROM walked")
def _(t):
    """The walk with a cap of forty fetches; what it found but did not fetch is listed too."""
    return _walk(t, 40).select("sitemap", "level", "fetched")


@query("sitemap_pages", f"WITH {_WALK} SELECT sitemap, loc FROM entries WHERE NOT is_index AND sitemap IN (SELECT sitemap FROM walked)")
def _(t):
    return R.sitemap_pages(R.sitemap_entries(t("sitemap_files")), _walk(t))


@query("distinct_urls", f"SELECT DISTINCT substr(url, 1, 160) AS url FROM links WHERE NOT regexp_matches(url, '(?i){K.ASSET}') AND NOT regexp_matches(url, '(?i){K.THIRD_PARTY}')")
def _(t):
    return M.recorded_requests(t("links"))


@query("sorted_urls", f"SELECT url, row_number() OVER (ORDER BY url) AS place FROM (SELECT DISTINCT substr(url, 1, 160) AS url FROM links WHERE NOT regexp_matches(url, '(?i){K.ASSET}') AND NOT regexp_matches(url, '(?i){K.THIRD_PARTY}'))")
def _(t):
    return ordered(M.recorded_requests(t("links")), "url")


@query("body_capture", f"SELECT page_id, url, substr('body ' || page_id, 1, 400000) AS body FROM links WHERE regexp_matches(url, '/api/') AND NOT regexp_matches(url, '(?i){K.ASSET}')")
def _(t):
    return M.api_bodies(t("links").select("page_id", "url", F.concat(F.lit("body "), "page_id").alias("body")))


@query(
    "largest_media",
    """SELECT media_id, arg_min(page_id, struct_pack(s := -size, q := page_id)) AS seq, max(size) AS size FROM (
         SELECT page_id, nullif(regexp_extract(url, '/media/([0-9]+)/', 1), '') AS media_id, url, 9000 + (page_id * 37) % 5000 AS size FROM links)
       WHERE media_id IS NOT NULL AND NOT contains(url, 'crop_square') AND size > 10000 GROUP BY 1""",
)
def _(t):
    rows = t("links").select(F.col("page_id").alias("seq"), "url", F.expr("9000 + (page_id * 37) % 5000").alias("size"))
    return M.largest_media(rows, "/media/([0-9]+)/", F.col("size") > K.MIN_JPEG_BYTES)


@query(
    "jpeg_frame",
    """WITH sized AS (SELECT page_id, page_id % 4 AS k, 8 * strlen(html) + CASE page_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 2 WHEN 2 THEN 7 ELSE 0 END AS size FROM pages),
        framed AS (SELECT *, k < 3 AND size > 3 AS starts, CASE k WHEN 0 THEN size - 2 WHEN 2 THEN size - 5 ELSE -1 END AS end_at FROM sized)
        SELECT page_id, size, starts, end_at, CASE WHEN size = 0 THEN 'empty' WHEN NOT starts THEN 'not a jpeg' WHEN end_at < 0 THEN 'truncated (no EOI)' WHEN size <= 10000 THEN 'too small (' || size || 'b)' WHEN k = 2 THEN 'ok (3b trailing after EOI)' ELSE 'ok' END AS state,
            size > 10000 AND starts AND end_at > 0 AS valid, k = 0 AS strict FROM framed""",
)
def _(t):
    """Buffers made of page bytes: framed, cut off, too small, or no image at all."""
    body = F.encode(F.repeat("html", 8), "UTF-8")
    start, end = F.unhex(F.lit("FFD8")), F.unhex(F.lit("FFD9"))
    data = (
        F.when(F.col("page_id") % 4 == 0, F.concat(start, body, end))
        .when(F.col("page_id") % 4 == 1, F.concat(start, body))
        .when(F.col("page_id") % 4 == 2, F.concat(start, body, end, F.encode(F.lit("log"), "UTF-8")))
        .otherwise(body)
    )
    return t("pages").select("page_id", M.jpeg_frame(data).alias("f")).select("page_id", "f.*")


#: The head of a bitmap of 8 x 40 pixels of three bytes, with its lowest row first.
_BITMAP = "424DF603000000000000360000002800000008000000280000000100180000000000C0030000130B0000130B00000000000000000000"


@query(
    "jpeg_band_files",
    """SELECT k, CASE WHEN k % 4 = 3 THEN 'undecodable' WHEN k % 3 = 0 THEN '4/4 lower bands are decoder fill grey' WHEN k % 3 = 1 THEN '2/4 lower bands are decoder fill grey' ELSE 'ok' END AS reason, k % 4 = 3 OR k % 3 < 2 AS bad, n
       FROM (SELECT page_id % 40 AS k, count(*) AS n FROM pages GROUP BY 1)""",
)
def _(t):
    """An image file for each of forty groups of pages: all grey, grey below, striped, or no image; decoded by Spark and judged."""
    path = _new(t, "images")
    groups = t("pages").groupBy((F.col("page_id") % 40).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    grey, striped = (lambda rows, p=p: F.repeat(F.lit(p), 4 * rows) for p in ("808080808080", "00FF7F1040C0"))  # of eight pixels a row
    pixels = F.when(F.col("k") % 3 == 0, grey(40)).when(F.col("k") % 3 == 1, F.concat(grey(12), striped(28))).otherwise(striped(40))
    value = F.when(F.col("k") % 4 == 3, F.lit("no image")).otherwise(F.unhex(F.concat(F.lit(_BITMAP), pixels)).cast("string"))
    groups.select("k", value.alias("value")).repartition("k").write.partitionBy("k").text(path)
    found = M.inspect_images(readers.images(t.spark, path, "part-*"))
    return found.select(F.regexp_extract("path", "/k=([0-9]+)/", 1).cast("long").alias("k"), "reason", "bad").join(groups, "k")


@query("jpeg_bands", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 4 WHEN page_id % 3 = 1 THEN 2 ELSE 0 END AS flat FROM pages")
def _(t):
    """Images of 8 x 40 pixels: all grey, grey in the last two bands, or striped."""
    pixel = F.expr(
        """transform(sequence(0, 8 * 40 * 3 - 1), i -> case when page_id % 3 = 0 then 128
           when page_id % 3 = 1 and i >= 8 * 28 * 3 then 128 else (i * 53) % 251 end)"""
    )
    return t("pages").select("page_id", M.flat_bands(F.lit(8), F.lit(40), pixel).alias("flat"))


@query(
    "consent_match",
    """SELECT page_id, substr(list_filter([CASE WHEN page_id % 2 = 0 THEN 'Reject' ELSE ' accept all' END, CASE WHEN page_id % 3 = 0 THEN 'GOT IT!' ELSE 'More' END], lambda x: starts_with(lower(trim(x)), 'accept') OR starts_with(lower(trim(x)), 'got it'))[1], 1, 40).trim() AS label
       FROM pages""",
)
def _(t):
    labels = F.expr("array(case when page_id % 2 = 0 then 'Reject' else ' accept all' end, case when page_id % 3 = 0 then 'GOT IT!' else 'More' end)")
    return t("pages").select("page_id", T.consent_match(labels, K.LOCALES["en"]["consent_labels"]).alias("label"))


@query("txt_has_headless", "SELECT page_id, contains(lower(CASE WHEN page_id % 4 = 0 THEN 'HeadlessChrome ' || url ELSE url END), 'headless') AS headless FROM pages")
def _(t):
    return t("pages").select("page_id", T.has_headless(F.expr("case when page_id % 4 = 0 then concat('HeadlessChrome ', url) else url end")).alias("headless"))


@query("http_ok_range", "SELECT url, CASE WHEN http_status BETWEEN 200 AND 399 THEN 0 ELSE 1 END AS exit_code FROM link_states")
def _(t):
    return t("link_states").select("url", O.ok_exit("http_status").alias("exit_code"))


@query("exit_code", f"SELECT page_id, CASE WHEN contains(lower(coalesce({_TITLE}, '')), 'just a moment') THEN 3 WHEN page_id % 6 = 1 THEN 2 WHEN coalesce({_TITLE}, '') = '' THEN 1 ELSE 0 END AS exit_code FROM made_pages")
def _(t):
    title = H.title("html")
    code = F.when(T.is_challenge_title(title), 3).when(F.col("page_id") % 6 == 1, 2).when(F.coalesce(title, F.lit("")) == "", 1).otherwise(0)
    return t("made_pages").select("page_id", code.alias("exit_code"))


@query("snk_sentinel", "SELECT page_id AS id FROM pages WHERE NOT (page_id % 3 = 0)")
def _(t):
    """Pages without a parsed record of more than zero bytes."""
    parsed = t("pages").where("page_id % 3 < 2").select(F.col("page_id").alias("id"), F.expr("case when page_id % 3 = 0 then 10 else 0 end").alias("bytes"))
    return store.pending(t("pages").select(F.col("page_id").alias("id")), parsed)


@query(
    "snk_reparse",
    f"""SELECT page_id AS id, to_json({{'title': {_TITLE}}}) IS NOT NULL AS parsed, CASE WHEN page_id % 2 = 0 THEN url END AS url, {_TITLE} AS title FROM made_pages""",
)
def _(t):
    rows = t("made_pages")
    raw = rows.select(F.col("page_id").alias("id"), F.col("html").alias("body"))
    before = rows.where("page_id % 2 = 0").select(F.col("page_id").alias("id"), "url", F.lit(None).cast("timestamp").alias("fetched_at"))
    found = store.reparse(raw, before, F.to_json(F.struct(H.title("body").alias("title"))))
    return found.select("id", F.col("record").isNotNull().alias("parsed"), "url", F.get_json_object("record", "$.title").alias("title"))


def _new(t, name: str) -> str:
    return f"{store.shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("src_pages_glob", "SELECT page_id % 40 AS bucket, sum(length(html) + 1) AS chars FROM pages GROUP BY 1")
def _(t):
    """Page files, a file for each of forty groups of pages, read back as files."""
    path = _new(t, "pages")
    t("pages").select((F.col("page_id") % 40).alias("bucket"), "html").repartition("bucket").write.partitionBy("bucket").text(path)
    found = readers.pages(t.spark, path, "part-*")
    bucket = F.regexp_extract("path", "/bucket=([0-9]+)/", 1).cast("long")
    return found.groupBy(bucket.alias("bucket")).agg(F.sum(F.length("html")).alias("chars"))


@query("src_gzip", "SELECT page_id, length(html) AS chars, sha256(html) AS sha FROM pages")
def _(t):
    """Gzip files of pages, read back as bytes and unpacked."""
    path = _new(t, "gzip")
    t("pages").select(F.to_json(F.struct("page_id", "html")).alias("value")).write.option("compression", "gzip").text(path)
    whole = readers.responses(t.spark, path, "part-*")
    lines = whole.select(F.explode(F.split(readers.replaced_utf8("content"), "\n")).alias("line")).where("line <> ''")
    page = F.from_json("line", "page_id long, html string")
    return lines.select(page.alias("p")).select("p.page_id", F.length("p.html").cast("long").alias("chars"), F.sha2("p.html", 256).alias("sha"))
