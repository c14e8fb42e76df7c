"""Documents with anchors and headings, templates, and blocks that are sent out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import collapse, col, text_or_empty
from .ordering import ordered

#: The order of the parts of a composed prompt; an empty part is left out.
SECTIONS = ("role", "process", "grounding", "census", "blocked", "anti_list", "field_rules", "schema", "self_report", "output", "restatement")


def slice_anchors(text: Column | str, begin: str = K.PROMPT_BEGIN, end: str = K.PROMPT_END) -> Column:
    """struct(body, error): the text between two anchors without line ends around it."""
    t = text_or_empty(text)
    start, stop = F.locate(begin, t), F.locate(end, t)
    error = (
        F.when((start == 0) | (stop == 0), "missing")
        .when(F.locate(begin, F.substr(t, start + 1)) > 0, "repeated")
        .when(stop <= start, "reversed")
    )
    body = F.regexp_replace(F.substr(t, start + len(begin), stop - start - len(begin)), r"^\n+|\n+$", "")
    return F.struct(F.when(error.isNull(), body).alias("body"), error.alias("error"))


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, level, title) of the headings outside fences."""
    rows = docs.select(key, F.posexplode(F.split(text_or_empty(text), "\n")).alias("line", "_l"))
    fence = F.ltrim("_l").startswith("```")
    open_now = F.sum(fence.cast("int")).over(Window.partitionBy(key).orderBy("line")) % 2 == 1
    pattern = r"^(#+)\s+(\S.*?)\s*$"
    kept = rows.withColumn("_open", open_now | fence).where(~F.col("_open") & F.col("_l").rlike(pattern))
    return kept.select(key, "line", F.length(F.regexp_extract("_l", pattern, 1)).alias("level"), F.regexp_extract("_l", pattern, 2).alias("title"))


def lift_block(docs: DataFrame, key: str, text: str, title: str, language: str = "ya?ml") -> DataFrame:
    """(key, block): the first fenced block of a section, up to the next heading of its level or above."""
    found = headings(docs, key, text)
    own = found.where(F.col("title") == title).groupBy(key).agg(F.min(F.struct("line", "level")).alias("h"))
    after = found.join(own, key).where((F.col("line") > F.col("h.line")) & (F.col("level") <= F.col("h.level"))).groupBy(key).agg(F.min("line").alias("stop"))
    joined = docs.select(key, F.split(text_or_empty(text), "\n").alias("_ls")).join(own, key).join(after, key, "left")
    section = F.array_join(F.slice("_ls", F.col("h.line") + 1, F.coalesce("stop", F.size("_ls")) - F.col("h.line")), "\n")
    pattern = rf"(?s)```{language}\s*\n(.*?)\n```"
    return joined.select(key, F.when(section.rlike(pattern), F.rtrim(F.regexp_extract(section, pattern, 1))).alias("block"))


def placeholders(template: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text_or_empty(template), F.lit(K.PLACEHOLDER), F.lit(1))))


def unknown_placeholders(template: Column | str, known: list[str]) -> Column:
    return F.array_except(placeholders(template), F.array(*map(F.lit, known)).cast("array<string>"))


def fill(template: Column | str, values: dict[str, Column]) -> Column:
    """struct(text, error): the template with its values; a missing or null value is an error."""
    t = text_or_empty(template)
    missing = unknown_placeholders(template, list(values))
    nulls = F.filter(F.array(*(F.when(v.isNull() & F.contains(t, F.lit("{{" + k + "}}")), F.lit(k)) for k, v in values.items())), lambda x: x.isNotNull())
    out = t
    for k, v in values.items():
        out = F.replace(out, F.lit("{{" + k + "}}"), F.coalesce(v.cast("string"), F.lit("")))
    error = (
        F.when(F.size(missing) > 0, F.concat(F.lit("unknown: "), F.array_join(missing, ", ")))
        .when(F.size(nulls) > 0, F.concat(F.lit("null: "), F.array_join(nulls, ", ")))
        .when(F.contains(out, F.lit("{{")) | F.contains(out, F.lit("}}")), "unfilled")
    )
    return F.struct(F.when(error.isNull(), out).alias("text"), error.alias("error"))


def version(text: Column | str) -> Column:
    """struct(number, dated) of the version line; null without one."""
    t = text_or_empty(text)
    return F.when(t.rlike(K.VERSION), F.struct(F.regexp_extract(t, K.VERSION, 1).cast("int").alias("number"), F.trim(F.regexp_extract(t, K.VERSION, 2)).alias("dated")))


def missing_phrases(text: Column | str, phrases: list[str] | tuple[str, ...], collapsed: bool = True) -> Column:
    """The phrases that a text lacks, white space aside."""
    t = collapse(text) if collapsed else text_or_empty(text)
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: ~F.contains(t, p))


def run_id(label: Column | str, when: Column | str) -> Column:
    """label-stamp-hash, the hash over both."""
    stamp = F.date_format(col(when), "yyyyMMdd'T'HHmm")
    return F.concat(col(label), F.lit("-"), stamp, F.lit("-"), F.substring(F.sha1(F.concat(col(label), F.lit(":"), stamp)), 1, 6))


def block(prompt: Column, item: Column, run: Column | None = None, group: Column | None = None, marker: str = K.ITEM_MARKER) -> Column:
    """A prompt framed by rules, with a header and a tag that names its item."""
    rule = "=" * K.RULE_WIDTH
    name = item if group is None else F.concat(group, F.lit("/"), item)
    header = F.concat(F.lit(f"# {marker}: "), name)
    if run is not None:
        header = F.concat(header, F.lit("  run="), run)
    return F.concat(F.lit(f"{rule}\n"), header, F.lit(f"\n{rule}\n[{marker}: "), name, F.lit("]\n"), prompt, F.lit("\n"))


def padded(*values: Column) -> Column:
    """Values in columns of 40, longer ones whole, two blanks between, none at the end."""
    wide = [F.when(F.length(v) >= 40, v).otherwise(F.rpad(v, 40, " ")) for v in (F.coalesce(F.nullif(c, F.lit("")), F.lit("-")) for c in values)]
    return F.rtrim(F.concat_ws("  ", *wide))


def assemble(parts: dict[str, Column]) -> Column:
    """The parts that hold something, in the fixed order, a blank line between."""
    unknown = set(parts) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    named = [F.nullif(F.coalesce(parts[s], F.lit("")), F.lit("")) for s in SECTIONS if s in parts]
    return F.concat_ws("\n\n", *named)


def plan_manifest(prompts: DataFrame, item: str, prompt: str, document: str, run: str) -> DataFrame:
    """``manifest`` of a plan, with what each prompt came from: run, and version, date and hash of the prompt document."""
    found = version(F.lit(document))
    held = manifest(prompts, item, prompt)
    return held.withColumns({"run": F.lit(run), "prompt_version": found["number"], "prompt_dated": found["dated"], "document_sha256": F.sha2(F.lit(document), 256)})


def dry_run(items: DataFrame, item: str, title: str) -> DataFrame:
    """(place, line): a line for each item in the order of its id, and how many there are as the last one."""
    lines = ordered(items.select(F.col(item).alias("item"), F.col(title).alias("title")), "item").select("place", padded(F.col("item"), F.col("title")).alias("line"))
    n = F.count(F.lit(1))
    return lines.union(items.agg((n + 1).alias("place"), F.concat(n.cast("string"), F.lit(" items")).alias("line")))


def manifest(prompts: DataFrame, item: str, prompt: str) -> DataFrame:
    """Per prompt its length and hash: what a plan keeps beside the prompts."""
    return prompts.select(item, F.length(prompt).alias("chars"), F.sha2(F.col(prompt), 256).alias("sha256"))
