"""Reading record files, replies, transcripts and pages, and the raw store."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from . import versions


def json_records(spark: SparkSession, path: str, by: str = "id") -> DataFrame:
    """(ordinal, key, record) of whole-file JSON: an array, or an object whose values are the records.

    Each file is one value; its records are variants.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    return explode_records(files.where("v is not null"), "v")


def explode_records(rows: DataFrame, variant: str) -> DataFrame:
    keep = ", ".join(f"t.`{c}`" for c in rows.columns if c != variant)
    return rows.sparkSession.sql(
        f"select {keep + ', ' if keep else ''}e.pos as ordinal, e.key, e.value as record from {{rows}} t, lateral variant_explode(t.`{variant}`) e", rows=rows
    )


def tolerant_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines of JSON as variants; blank and broken ones are left out."""
    parsed = F.try_parse_json(F.trim(value))
    return lines.where((F.trim(value) != "") & parsed.isNotNull()).withColumn("record", parsed)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    return tolerant_lines(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"))


def worklist(rows: DataFrame, key: str = "id") -> DataFrame:
    """(ordinal, id, title, url) of variants ``record`` with ``ordinal``; a bare text is an id."""
    bare = F.expr("try_variant_get(record, '$', 'string')")
    is_text = F.schema_of_variant("record") == "STRING"
    field = lambda name: F.expr(f"try_variant_get(record, '$.{name}', 'string')")
    return rows.select("ordinal", F.when(is_text, bare).otherwise(field(key)).alias("id"), field("title").alias("title"), field("url").alias("url"))


def keyless(items: DataFrame) -> DataFrame:
    """The items without a key; a work-list with any is refused."""
    return items.where(F.coalesce(F.col("id").cast("string"), F.lit("")) == "")


def keyed(items: DataFrame) -> DataFrame:
    """``items``, refused while it runs if one has no key."""
    known = F.coalesce(F.col("id").cast("string"), F.lit("")) != ""
    told = F.concat(F.lit("work-list entry without a key at "), F.col("ordinal").cast("string"))
    return items.withColumn("id", F.when(known, F.col("id")).otherwise(F.raise_error(told).cast(items.schema["id"].dataType)))


def drive_items(rows: DataFrame) -> DataFrame:
    """Like ``worklist``; a bare text is both id and url, and a missing id is the url."""
    items = worklist(rows)
    return items.select("ordinal", F.coalesce("id", "url").alias("id"), F.coalesce("url", "id").alias("url"))


def link_states(spark: SparkSession, path: str, fields: str, version: int | None = None) -> DataFrame:
    """(url, fields) of state files, objects by address: the current version of ``path``, or plain files in it.

    A path that holds none, or that isn't there yet, gives no rows.
    """
    if versions.latest(spark, path):
        lines = versions.read(spark, path, "value string", version)
    else:
        try:
            lines = spark.read.text(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            lines = spark.createDataFrame([], "value string")
    states = lines.select(F.from_json("value", f"map<string, struct<{fields}>>").alias("m"))
    return states.select(F.explode("m").alias("url", "s")).select("url", "s.*")


def value_maps(spark: SparkSession, path: str) -> DataFrame:
    """(field, old, new) of files with JSON value maps: field to old to new value."""
    return explode_value_maps(spark.read.text(path), "value")


def explode_value_maps(rows: DataFrame, value: str) -> DataFrame:
    parsed = rows.select(F.from_json(value, "map<string, map<string, string>>").alias("m")).select(F.explode("m").alias("field", "m"))
    return parsed.select("field", F.explode("m").alias("old", "new"))


def indexed(rows: DataFrame, name: str, index: DataFrame, agent: str = "agent_id") -> DataFrame:
    """``rows`` with ``agent``: what ``index`` (name, agent) says of the name, else the name itself."""
    known = index.select(F.col(index.columns[0]).alias("known_name"), F.col(index.columns[1]).alias("known_agent"))
    joined = rows.join(known, rows[name] == known["known_name"], "left")
    return joined.withColumn(agent, F.coalesce("known_agent", name)).drop("known_name", "known_agent")


def replies(spark: SparkSession, path: str, index: DataFrame | None = None, stem: str = r"([^/]*?)(\.[^./]*)?$") -> DataFrame:
    """(agent_id, item_id, text, source) of reply files; ``index`` maps item_id to agent_id, else the stem is the agent.

    ``stem``: the pattern whose first group takes the stem from a file's path.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    files = files.withColumn("stem", F.regexp_extract("source", stem, 1)).where("stem <> 'index'")
    if index is None:
        return files.select(F.col("stem").alias("agent_id"), F.lit(None).cast("string").alias("item_id"), "text", "source")
    named = index.select(F.col("item_id").alias("stem"), F.col("agent_id").alias("a"))
    joined = files.join(named, "stem", "left")
    return joined.select(F.coalesce("a", "stem").alias("agent_id"), F.when(F.col("a").isNotNull(), F.col("stem")).alias("item_id"), "text", "source")


def transcript_lines(files: DataFrame, path: str = "path", value: str = "value") -> DataFrame:
    """(path, line_no, value) of whole transcripts."""
    return files.select(path, F.posexplode(F.split(value, "\n")).alias("line_no", "value"))


def transcripts(spark: SparkSession, root: str, files: str = "agent-*.jsonl", below: str = "/subagents/agent-[^/]*$") -> DataFrame:
    """(path, line_no, value) of ``agent-*.jsonl`` below ``root``/project/session/subagents.

    Line numbers come from the place in the whole file, so a file is read by one task.
    """
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(root, wholetext=True)
    rows = transcript_lines(whole.select(F.col("_metadata.file_path").alias("path"), "value"))
    return rows.where(F.col("path").rlike(below))


def sidecars(spark: SparkSession, root: str, files: str = "agent-*.meta.json", ending: str = r"\.meta\.json$") -> DataFrame:
    """(path of the transcript, description, tool_use_id, stopped) of the files beside transcripts.

    ``ending``: what of a file's path gives way to ``.jsonl``.
    """
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(root, wholetext=True)
    paths = F.regexp_replace(F.col("_metadata.file_path"), ending, ".jsonl")
    return parse_sidecars(found.select(paths.alias("path"), "value"))


def parse_sidecars(files: DataFrame) -> DataFrame:
    """(path, description, tool_use_id, stopped) of (path, value)."""
    m = F.from_json("value", "description string, toolUseId string, stoppedByUser boolean")
    return files.select("path", m["description"].alias("description"), m["toolUseId"].alias("tool_use_id"), m["stoppedByUser"].alias("stopped"))


def pages(spark: SparkSession, path: str, files: str = "*.html") -> DataFrame:
    """(path, html) of page files; broken bytes are replaced."""
    return responses(spark, path, files).select("path", replaced_utf8("content").alias("html"))


def responses(spark: SparkSession, path: str, files: str) -> DataFrame:
    """(path, content) of response files; gzip data is unpacked, by its first bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.when(F.substring("content", 1, 2) == F.unhex(F.lit("1F8B")), gunzip("content")).otherwise(F.col("content")).alias("content"))


def images(spark: SparkSession, path: str, files: str = "*.jp*g") -> DataFrame:
    """(path, height, width, channels, data) of image files, decoded by Spark's image source; what can't be decoded has no data.

    Spark lists no files of zero bytes; a work-list tells which are missing.  ``data``: rows from the top, pixels from the left, blue, green and red of each (one value if grey).
    """
    found = spark.read.format("image").option("dropInvalid", "false").option("pathGlobFilter", files).option("recursiveFileLookup", "true").load(path)
    decoded = F.col("image.height") > 0
    part = lambda c: F.when(decoded, F.col(f"image.{c}"))
    return found.select(F.col("image.origin").alias("path"), part("height").alias("height"), part("width").alias("width"), part("nChannels").alias("channels"), part("data").alias("data"))


def replaced_utf8(data: Column | str) -> Column:
    """Bytes as text, with U+FFFD for what is no UTF-8."""
    return F.make_valid_utf8((F.col(data) if isinstance(data, str) else data).cast("string"))


@F.pandas_udf(BinaryType())
def gunzip(data: pd.Series) -> pd.Series:
    """The content of gzip data; anything else as it is."""
    return data.map(lambda b: gzip.decompress(b) if b is not None and bytes(b[:2]) == b"\x1f\x8b" else b)
