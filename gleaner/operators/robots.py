"""Robots rules and sitemaps as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import col, text_or_empty
from ..sources.store import stored
from .ordering import ordered


def load(origins: DataFrame, files: DataFrame, key: str = "origin", text: str = "robots") -> DataFrame:
    """(key, text, reachable) for every origin: one without a file, or whose file could not be read, lets nothing through."""
    joined = origins.select(key).distinct().join(files.select(key, text), key, "left")
    return joined.withColumn("reachable", F.col(text).isNotNull())


def lines(files: DataFrame, key: str = "origin", text: str = "robots") -> DataFrame:
    """(key, pos, field, value) of the lines that say something, comments cut off."""
    raw = files.select(key, F.posexplode(F.split(text_or_empty(text), r"\r\n|\r|\n")).alias("pos", "_l"))
    line = F.trim(F.element_at(F.split("_l", "#"), 1))
    cut = raw.select(key, "pos", line.alias("_l")).where(F.contains("_l", F.lit(":")))
    return cut.select(
        key,
        "pos",
        F.lower(F.trim(F.regexp_extract("_l", "^([^:]*):", 1))).alias("field"),
        F.trim(F.regexp_extract("_l", "^[^:]*:(.*)$", 1)).alias("value"),
    )


def groups(parsed: DataFrame, key: str = "origin") -> DataFrame:
    """Lines with the number of their group: consecutive user-agent lines open one together."""
    by_place = Window.partitionBy(key).orderBy("pos")
    agent = F.col("field") == "user-agent"
    opens = agent & ~F.coalesce(F.lag("field").over(by_place) == "user-agent", F.lit(False))
    return parsed.withColumn("grp", F.sum(opens.cast("int")).over(by_place))


def pattern_regex(pattern: Column | str) -> Column:
    """A path pattern as an anchored regex: * is anything, a last $ is the end, all else is itself."""
    p = col(pattern)
    p = F.when(F.startswith(p, F.lit("/")) | F.startswith(p, F.lit("*")), p).otherwise(F.concat(F.lit("*"), p))
    ends = F.endswith(p, F.lit("$"))
    body = F.when(ends, F.regexp_replace(p, r"\$$", "")).otherwise(p)
    quoted = F.replace(F.regexp_replace(body, r"([^A-Za-z0-9*/_-])", r"\\$1"), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), quoted, F.when(ends, F.lit("$")).otherwise(F.lit("")))


def rules(files: DataFrame, key: str = "origin", text: str = "robots") -> DataFrame:
    """(key, agent, seq, allow, pattern, length, regex); an empty disallow says nothing."""
    grouped = groups(lines(files, key, text), key)
    agents = grouped.where("field = 'user-agent'").select(key, "grp", F.col("value").alias("agent")).distinct()
    said = grouped.where("field in ('allow', 'disallow') and grp > 0 and not (field = 'disallow' and value = '')")
    return said.join(agents, [key, "grp"]).select(
        key,
        "agent",
        F.col("pos").alias("seq"),
        (F.col("field") == "allow").alias("allow"),
        F.col("value").alias("pattern"),
        F.length("value").alias("length"),
        pattern_regex("value").alias("regex"),
    )


def literal(pattern: Column | str) -> Column:
    """What a pattern says up to its first wildcard or its anchor; one that begins with neither / nor * may begin anywhere."""
    p = col(pattern)
    anywhere = ~F.startswith(p, F.lit("/")) & ~F.startswith(p, F.lit("*"))
    return F.when(anywhere, F.lit("")).otherwise(F.regexp_extract(F.regexp_replace(p, r"\$$", ""), r"^[^*]*", 0))


def is_literal(pattern: Column | str) -> Column:
    """Whether all paths that begin with ``literal`` match."""
    p = col(pattern)
    return F.startswith(p, F.lit("/")) & ~F.contains(p, F.lit("*")) & ~F.endswith(p, F.lit("$"))


def agents(files: DataFrame, key: str = "origin", text: str = "robots") -> DataFrame:
    """(key, agent, crawl_delay): every agent named, with its last delay that is a number."""
    grouped = groups(lines(files, key, text), key)
    named = grouped.where("field = 'user-agent'").select(key, "grp", F.col("value").alias("agent"))
    delays = grouped.where("field = 'crawl-delay'").select(key, "grp", "pos", F.expr("try_cast(value as double)").alias("delay")).where("delay is not null")
    joined = named.join(delays, [key, "grp"], "left")
    return joined.groupBy(key, "agent").agg(F.max(F.when(F.col("delay").isNotNull(), F.struct("pos", "delay")))["delay"].alias("crawl_delay"))


def sitemaps(files: DataFrame, key: str = "origin", text: str = "robots") -> DataFrame:
    return lines(files, key, text).where("field = 'sitemap'").select(key, F.col("value").alias("sitemap"))


def chosen_agent(named: DataFrame, agent: str, key: str = "origin") -> DataFrame:
    """(key, agent) of the one group that applies: the longest name inside ``agent``, else *."""
    low = F.lit(agent.lower())
    fits = named.where((F.col("agent") == "*") | (F.contains(low, F.lower("agent")) & (F.col("agent") != "")))
    rank = F.struct((F.col("agent") != "*").alias("named"), F.length("agent").alias("n"), F.col("agent").alias("a"))
    return fits.groupBy(key).agg(F.max(rank)["a"].alias("agent"))


def allowed(links: DataFrame, files: DataFrame, agent: str, key: str = "origin", text: str = "robots", url: str = "url") -> DataFrame:
    """``links`` with ``allowed``.

    Of the applying group's rules that match, the longest pattern decides, allow before
    disallow; without a rule a link is allowed; without a robots text (null) none is.
    Rules meet paths by equality on origin and what a pattern says literally up to its first
    wildcard, for each length of that which the origin has, as one walk down a trie would; only
    patterns with a wildcard or an anchor are then tried, and only where that much is equal.
    """
    named = agents(files, key, text)
    applies = rules(files, key, text).join(chosen_agent(named, agent, key), [key, "agent"], "left_semi")
    paths = links.withColumn("_path", U.robots_path(url))
    held = applies.withColumns({"_literal": literal("pattern"), "_whole": is_literal("pattern")})
    lengths = held.groupBy(key).agg(F.collect_set(F.length("_literal")).alias("_lengths"))
    each = paths.select(key, "_path").distinct().join(lengths, key).select(key, "_path", F.explode("_lengths").alias("_n")).where(F.length("_path") >= F.col("_n"))
    met = each.withColumn("_literal", F.substr(F.col("_path"), F.lit(1), F.col("_n"))).join(held, [key, "_literal"])
    hits = met.where("_whole or _path rlike regex")
    best = hits.groupBy(key, "_path").agg(F.max(F.struct("length", "allow"))["allow"].alias("_allow"))
    reach = files.select(key, F.col(text).isNotNull().alias("_reach"))
    joined = paths.join(best, [key, "_path"], "left").join(reach, key, "left")
    return joined.withColumn("allowed", F.coalesce("_reach", F.lit(False)) & F.coalesce("_allow", F.lit(True))).drop("_path", "_allow", "_reach")


def sitemap_entries(files: DataFrame, key: str = "sitemap", xml: str = "xml") -> DataFrame:
    """(key, is_index, pos, loc) of sitemap files."""
    text = text_or_empty(xml)
    locs = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<(?:\w+:)?loc>(.*?)</(?:\w+:)?loc>"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    index = text.rlike(r"(?s)^\s*(<\?.*?\?>)?\s*<(\w+:)?sitemapindex\b")
    return files.select(key, index.alias("is_index"), F.posexplode(locs).alias("pos", "loc"))


def sitemap_walk(entries: DataFrame, roots: DataFrame, limit: int | None = None) -> DataFrame:
    """(sitemap, level, place, fetched) of all sitemaps reached from ``roots``, breadth first.

    A level is a join of the stored frontier with the stored index entries, and the walk goes on
    until a level has nothing new.  ``place`` is the order of discovery within the level: by the
    place of the index, then by the place in it.  ``limit`` caps the sitemaps that are fetched over
    all levels; what was discovered but not fetched is returned with ``fetched`` false.
    """
    edges = stored(entries.where("is_index").select("sitemap", "pos", F.col("loc").alias("child")), "sitemap-edges")
    frontier = ordered(roots.select(F.col(roots.columns[0]).alias("sitemap")).distinct(), "sitemap")
    seen, fetched, level = None, 0, 0
    while True:
        n = frontier.count()
        if seen is not None and not n:
            return seen
        taken = n if limit is None else max(0, min(n, limit - fetched))
        here = stored(frontier.select("sitemap", F.lit(level).alias("level"), "place", (F.col("place") <= taken).alias("fetched")), "sitemap-level")
        seen = here if seen is None else seen.union(here)
        fetched, level = fetched + taken, level + 1
        found = here.where("fetched").join(edges, "sitemap").groupBy(F.col("child").alias("sitemap")).agg(F.min(F.struct("place", "pos")).alias("at"))
        frontier = ordered(found.join(seen, "sitemap", "left_anti").select("sitemap", F.struct("at", "sitemap").alias("order")), "order")


def sitemap_pages(entries: DataFrame, walked: DataFrame) -> DataFrame:
    """(sitemap, loc) of the pages that fetched sitemaps name."""
    return entries.where("not is_index").join(walked.where("fetched").select("sitemap"), "sitemap", "left_semi").select("sitemap", "loc")
