"""Raw pages and what was parsed from them: raw is written first, so a parser's failure loses nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import versions

#: Pages that a Python parser holds at once.
PARSED = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without: there driver and executors are one process, and a
    folder below the warehouse serves.  A cluster without the setting is refused, because what
    an executor wrote to its own disk would be lost.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/gleaner-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back with the same schema."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Inputs below this size are dealt over all cores before costly work on each row.
SMALL_BYTES = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of ``df``, from the sizes of its files; nothing is read for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if Spark's own estimate of its size is less than a usual split.

    A small file with one row group is one task however many cores wait.  Only the dealing
    depends on the estimate, never the rows.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if plan_bytes(df) < SMALL_BYTES else df


def write_census(rolled: DataFrame, path: str) -> DataFrame:
    """Persist a census as a version and read it back; sorted by its columns inside each file."""
    versions.write(rolled.sortWithinPartitions(*rolled.columns), path)
    return versions.read(rolled.sparkSession, path, rolled.schema)


def report(rows: DataFrame) -> DataFrame:
    """``value``: each row as JSON for other programs, null fields kept."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_states(states: DataFrame, path: str, base: int | None = None) -> dict[str, int]:
    """Link states as objects by address, a line each: {url: {...}}; the next version of ``path``.

    ``states`` may be read from the same path.
    """
    others = [c for c in states.columns if c != "url"]
    entry = F.create_map(F.col("url"), F.struct(*others))
    return versions.write(states.select(F.to_json(entry, {"ignoreNullFields": "false"}).alias("value")), path, "text", base=base)


def write_raw(rows: DataFrame, path: str) -> None:
    """(id, body): append raw bodies."""
    rows.select("id", "body").write.mode("append").parquet(path)


Parser = Callable[[str], dict | None]


def _parsed(raw: DataFrame, parser: Column | Parser) -> DataFrame:
    """(id, record, error) of (id, body)."""
    if isinstance(parser, Column):
        return raw.select("id", parser.alias("record")).withColumn("error", F.when(F.col("record").isNull(), "no record"))
    kind = raw.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PARSED):
                ids, bodies = b.column(0).slice(at, PARSED), b.column(1).slice(at, PARSED).to_pylist()
                records, errors = [], []
                for ident, body in zip(ids.to_pylist(), bodies, strict=True):
                    try:
                        found = {"id": ident, **(parser(body) or {})}
                        record, error = json.dumps(found, ensure_ascii=False, sort_keys=True), None
                    except Exception as failed:  # whatever a parser raises is kept with its row
                        record, error = None, f"{type(failed).__name__}: {failed}"
                    records.append(record)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([ids, pa.array(records, pa.string()), pa.array(errors, pa.string())], names=["id", "record", "error"])

    return spread(raw.select("id", "body")).mapInArrow(run, f"id {kind}, record string, error string")


def parse(raw: DataFrame, parser: Column | Parser, meta: DataFrame | None = None) -> DataFrame:
    """(id, record, error, bytes, url, fetched_at) of raw pages (id, body).

    ``parser`` is a Python function from a body to a dict (the record gets the id where it has
    none), or an expression that gives JSON text from ``body``.  A page on which it fails has no
    record and its error; all others are parsed.  ``bytes`` is 0 without a record, so the page is
    still pending.
    """
    out = _parsed(raw, parser).withColumn("bytes", F.coalesce(F.octet_length("record"), F.lit(0)))
    if meta is None:
        return out.withColumns({"url": F.lit(None).cast("string"), "fetched_at": F.lit(None).cast("timestamp")})
    return out.join(meta.select("id", "url", "fetched_at"), "id", "left")


def harvest(pages: DataFrame, parser: Column | Parser, raw_path: str, parsed_path: str, meta: DataFrame | None = None) -> DataFrame:
    """Write raw pages (id, body) first, then parse what was written, then write what was parsed; the parsed table.

    What the parser fails on keeps its raw body and its error.
    """
    spark = pages.sparkSession
    write_raw(pages, raw_path)
    raw = spark.read.schema(pages.select("id", "body").schema).parquet(raw_path)
    found = parse(raw.join(pages.select("id"), "id", "left_semi"), parser, meta)
    found.write.mode("append").parquet(parsed_path)
    return spark.read.schema(found.schema).parquet(parsed_path)


def pending(items: DataFrame, parsed: DataFrame) -> DataFrame:
    """The items without a parsed record of more than zero bytes."""
    return items.join(parsed.where("bytes > 0").select("id"), "id", "left_anti")


def reparse(raw: DataFrame, before: DataFrame, parser: Column | Parser) -> DataFrame:
    """Parse again from raw; only url and fetched_at are carried over, where the parser has none."""
    old = before.select("id", F.col("url").alias("_u"), F.col("fetched_at").alias("_f"))
    own_url = F.get_json_object("record", "$.url")
    own_time = F.try_to_timestamp(F.get_json_object("record", "$.fetched_at"))
    return _parsed(raw, parser).join(old, "id", "left").select(
        "id", "record", "error", F.coalesce(F.octet_length("record"), F.lit(0)).alias("bytes"), F.coalesce(own_url, "_u").alias("url"), F.coalesce(own_time, "_f").alias("fetched_at")
    )


def read_back(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if ids is None else rows.join(ids, "id", "left_semi")


def write_applied(records: DataFrame, worklist: DataFrame, path: str, dry_run: bool = False) -> dict:
    """Write the records (one to an id) that were asked for as the next version of ``path``; what was written and the census.

    written, matched, missing (asked, no record), extra (not asked), ok, dry_run and version.  All
    come from one pass: the census counts the rows of the join that the write goes on from.  A
    ``dry_run`` counts the same and writes nothing.
    """
    asked = worklist.select(F.col("id").alias("_asked")).distinct()
    both = records.join(asked, records["id"] == F.col("_asked"), "full")
    census = {
        "matched": F.count_if(F.col("id").isNotNull() & F.col("_asked").isNotNull()),
        "missing": F.count_if(F.col("id").isNull()),
        "extra": F.count_if(F.col("_asked").isNull()),
    }
    counts = [c.alias(n) for n, c in census.items()]
    if dry_run:
        found, version = both.agg(*counts).first().asDict(), None
    else:
        seen = Observation()
        kept = both.observe(seen, *counts).where(F.col("id").isNotNull() & F.col("_asked").isNotNull()).select(*(records[c] for c in records.columns))
        version = versions.write(kept.sortWithinPartitions("id"), path)["version"]
        found = seen.get
    return {"written": found["matched"], **found, "ok": not found["missing"] and not found["extra"], "dry_run": dry_run, "version": version}


def write_json(rows: DataFrame, path: str) -> dict[str, int]:
    """One JSON object per line, null fields kept, for people and other programs; the next version of ``path``."""
    return versions.write(rows, path, "json", ignoreNullFields="false")


def write_replies(results: DataFrame, path: str, files: int | None = None) -> None:
    """Recovered replies (agent_id, item_id, text) below ``path``: a text file to each item, and ``index``, which maps items to agents.

    An item's folder is named by its id, as ``readers.replies`` reads it.  Of repeated items the
    reply of the largest source stays.  ``files``: tasks that write, else at least as many as cores.
    A file costs some 20 ms however small it is, so the tasks are of a fixed number, which Spark does
    not coalesce by size, and each moves its own files into place; without ``_SUCCESS`` they aren't whole.
    """
    spark = results.sparkSession
    last = results.groupBy("item_id").agg(F.max_by(F.struct("agent_id", "text"), F.struct("source", "agent_id")).alias("r")).select("item_id", "r.*")
    held = stored(last, "replies")
    tasks = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = held.select(F.col("item_id").alias("stem"), F.col("text").alias("value")).repartition(tasks, "stem")
    dealt.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("stem").text(f"{path}/replies")
    held.select("item_id", "agent_id").write.mode("errorifexists").json(f"{path}/index")
