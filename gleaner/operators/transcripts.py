"""Agent transcripts, as lines of JSON with a place each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fences import marker_item

MESSAGE = """agentId string, type string, message struct<role: string, stop_reason: string, content: string>"""
PARTS = "array<struct<type: string, text: string>>"


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` with ``m`` parsed; blank and broken lines are left out."""
    whole = F.trim(value)
    good = lines.where((whole != "") & F.try_parse_json(whole).isNotNull())
    return good.withColumn("m", F.from_json(whole, MESSAGE))


def _parts(content: Column) -> Column:
    return F.when(F.startswith(F.trim(content), F.lit("[")), F.from_json(content, PARTS))


def turns(lines: DataFrame, value: str = "value") -> DataFrame:
    """``lines`` with what a fold takes from each: spoken (of a user), agent, turn (of the assistant) with stop, kind and said."""
    parsed = parse_lines(lines, value)
    content = F.col("m.message.content")
    parts = _parts(content)
    spoken = F.when(parts.isNull(), content).otherwise(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), " "))
    is_user = (F.col("m.type") == "user") & (F.col("m.message.role") == "user")
    block = F.try_element_at(parts, F.lit(-1))
    return parsed.withColumns(
        {
            "spoken": F.when(is_user, spoken),
            "agent": F.col("m.agentId"),
            "turn": F.coalesce(F.col("m.type") == "assistant", F.lit(False)),
            "stop": F.col("m.message.stop_reason"),
            "kind": block["type"],
            "said": block["text"],
        }
    ).drop("m")


def fold(lines: DataFrame, sidecars: DataFrame, path: str = "path", place: str = "line_no") -> DataFrame:
    """One row per transcript: path, agent_id, target, identified_by, text, complete, reason.

    ``sidecars``: (path, description, tool_use_id, stopped).  Only the first user message,
    the last assistant message and the agent id of the first line of a path are kept, by aggregation.
    """
    last = F.struct(place, "stop", F.struct(F.col("kind").alias("type"), F.col("said").alias("text")).alias("block"))
    folded = turns(lines).groupBy(path).agg(
        F.min(F.when(F.col("spoken").isNotNull(), F.struct(place, "spoken")))["spoken"].alias("asked"),
        F.max_by(last, F.when(F.col("turn"), F.col(place))).alias("last"),
        F.min(F.struct(place, "agent"))["agent"].alias("agent"),
    )
    return judged(lines.select(path).distinct().join(folded, path, "left").join(sidecars, path, "left"), path)


def judged(folded: DataFrame, path: str = "path") -> DataFrame:
    """The result of each folded transcript (path, asked, last, agent and the sidecar's columns)."""
    text = F.when(F.col("last.block.type") == "text", F.col("last.block.text"))
    complete = F.coalesce((F.col("last.stop") == "end_turn") & (F.col("last.block.type") == "text"), F.lit(False))
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*?)(\.jsonl)?$", 1), "^agent-", "")
    unreadable = F.col("asked").isNull() & F.col("last").isNull() & F.col("agent").isNull()
    reason = (
        F.when(complete, "ok")
        .when(F.coalesce("stopped", F.lit(False)) & ~unreadable, "stopped-by-user")
        .when(unreadable, "unreadable")
        .when(F.col("last").isNull(), "no-assistant")
        .otherwise("incomplete")
    )
    marked = marker_item("asked")
    described, tool = F.nullif(F.col("description"), F.lit("")), F.nullif(F.col("tool_use_id"), F.lit(""))
    how = F.when(marked.isNotNull(), "marker").when(described.isNotNull(), "description").when(tool.isNotNull(), "tool_use_id")
    return folded.select(
        path,
        F.coalesce("agent", stem).alias("agent_id"),
        F.coalesce(marked, described, tool).alias("target"),
        how.alias("identified_by"),
        text.alias("text"),
        complete.alias("complete"),
        reason.alias("reason"),
    )


def to_results(folded: DataFrame) -> DataFrame:
    kept = folded.where(F.col("complete") & (F.coalesce("text", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    return kept.select("agent_id", "text", F.col("path").alias("source"), F.col("target").alias("item_id"))


def summary(folded: DataFrame) -> DataFrame:
    by = lambda how: F.count_if(F.col("identified_by") == how).alias(f"by_{how}")
    return folded.agg(
        F.count(F.lit(1)).alias("transcripts"),
        F.count_if(F.col("complete") & F.col("target").isNotNull()).alias("recoverable"),
        by("marker"),
        by("description"),
        by("tool_use_id"),
    )
