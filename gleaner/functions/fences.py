"""Fenced blocks and self reports in replies, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import text_or_empty


def blocks(text: Column | str) -> Column:
    """All fenced blocks as array of struct(language, body, pos), in order."""
    text = text_or_empty(text)
    languages = F.regexp_extract_all(text, F.lit(K.FENCE), F.lit(1))
    bodies = F.regexp_extract_all(text, F.lit(K.FENCE), F.lit(2))
    return F.transform(languages, lambda x, i: F.struct(F.lower(x).alias("language"), F.get(bodies, i).alias("body"), i.alias("pos")))


def largest(found: Column, marker: str | None = None) -> Column:
    """The body of the longest block, of equals the first; blocks with the marker come first."""
    marked = F.lit(0) if marker is None else None
    ranked = F.transform(
        found,
        lambda b: F.struct(
            (F.contains(b["body"], F.lit(marker)).cast("int") if marked is None else marked).alias("marked"),
            F.length(b["body"]).alias("n"),
            (-b["pos"]).alias("back"),
            b["body"].alias("body"),
        ),
    )
    return F.array_max(ranked)["body"]


def select_block(text: Column | str, marker: str | None = None, language: str | None = None) -> Column:
    found = blocks(text)
    if language:
        found = F.filter(found, lambda b: b["language"] == language.lower())
    return largest(found, marker)


def json_block(text: Column | str, marker: str | None = None) -> Column:
    """A block tagged json, else any block; null without one."""
    return F.coalesce(select_block(text, marker, "json"), select_block(text, marker))


def json_status(text: Column | str, marker: str | None = None) -> Column:
    body = json_block(text, marker)
    return F.when(body.isNull(), "no-block").when(F.try_parse_json(body).isNull(), "unparseable").otherwise("ok")


def self_report(text: Column | str) -> Column:
    """struct(n, m, excluded) of a ``verification: N of M`` line; null without one."""
    text = text_or_empty(text)
    rest = F.regexp_extract(text, K.SELF_REPORT, 3)
    listed = F.regexp_replace(F.trim(F.regexp_extract(rest, r"(?i)excluded:\s*(.*)", 1)), r"\.+$", "")
    names = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "")
    excluded = F.when(F.lower(listed).isin("", "none", '"none"'), F.array().cast("array<string>")).otherwise(names)
    return F.when(
        text.rlike(K.SELF_REPORT),
        F.struct(
            F.regexp_extract(text, K.SELF_REPORT, 1).cast("long").alias("n"), F.regexp_extract(text, K.SELF_REPORT, 2).cast("long").alias("m"), excluded.alias("excluded")
        ),
    )


def strip_self_report(text: Column | str) -> Column:
    """The text without the lines of a self report."""
    text = text_or_empty(text)
    kept = F.array_join(F.filter(F.split(text, "\r?\n"), lambda line: ~line.rlike(K.SELF_REPORT)), "\n")
    return F.when(text.rlike(K.SELF_REPORT), F.regexp_replace(kept, r"^\s+|\s+$", "")).otherwise(text)


def marker_item(text: Column | str, marker: str = K.ITEM_MARKER) -> Column:
    """What stands between ``[marker: `` and the next bracket; null if nothing does."""
    return F.nullif(F.trim(F.regexp_extract(text_or_empty(text), rf"(?s)\[{marker}: ([^\]]*)\]", 1)), F.lit(""))
