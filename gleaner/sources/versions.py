"""Tables that are replaced as a whole: immutable versions, and a manifest that says which is current.

A version is written to a folder of its own, so what is being read is never touched and a
version may be made from the one before at the same path.  Only when all of it is there, a line
is added to the manifest; the file that holds the line appears at once (Spark renames it), so a
reader sees the old version or the new one, and a write that fails leaves the old one.

Of two writers that publish the same version number, the one with the smaller id wins, and the
other is told: its change was made from a version that is no longer the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "version long, id string, format string, rows long, published_at timestamp"


class ConcurrentWrite(RuntimeError):
    """Another writer published a version meanwhile; read again and repeat the change."""


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The versions below ``path``, one row each: version, id, format, rows, published_at; none if there is no such path."""
    try:
        lines = spark.read.schema(_MANIFEST).json(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)
    return lines.groupBy("version").agg(F.min_by(F.struct("id", "format", "rows", "published_at"), "id").alias("v")).select("version", "v.*")


def _entry(spark: SparkSession, path: str, version: int | None):
    rows = manifest(spark, path)
    return (rows if version is None else rows.where(F.col("version") == version)).orderBy(F.desc("version")).first()


def latest(spark: SparkSession, path: str) -> int:
    """The current version; 0 if nothing was published."""
    found = _entry(spark, path, None)
    return found["version"] if found else 0


def read(spark: SparkSession, path: str, schema: str | StructType, version: int | None = None) -> DataFrame:
    """The current version, or an earlier one by its number; no rows where nothing was published."""
    found = _entry(spark, path, version)
    if found is None:
        if version is not None:
            raise ValueError(f"no version {version} below {path}")
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(found["format"]).load(f"{path}/data/{found['id']}")


def write(rows: DataFrame, path: str, form: str = "parquet", base: int | None = None, metrics: dict[str, Column] | None = None, **options) -> dict[str, int]:
    """Write ``rows`` as the next version and publish it; the version, the rows written, and ``metrics``.

    ``base``: the version that ``rows`` were made from, if they were.  All numbers come from the
    write itself; ``metrics`` are aggregates over ``rows``.
    """
    spark = rows.sparkSession
    before = latest(spark, path)
    if base is not None and base != before:
        raise ConcurrentWrite(f"version {base} of {path} is no longer the last")
    seen, own = Observation(), uuid.uuid4().hex
    watched = rows.observe(seen, F.count(F.lit(1)).alias("written"), *(c.alias(n) for n, c in (metrics or {}).items()))
    watched.write.mode("errorifexists").format(form).options(**options).save(f"{path}/data/{own}")
    numbers = {"version": before + 1, **seen.get}
    line = spark.range(1).select(
        F.lit(numbers["version"]).cast("long").alias("version"),
        F.lit(own).alias("id"),
        F.lit(form).alias("format"),
        F.lit(numbers["written"]).cast("long").alias("rows"),
        F.current_timestamp().alias("published_at"),
    )
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    winner = _entry(spark, path, before + 1)
    if winner["id"] != own:
        raise ConcurrentWrite(f"version {before + 1} of {path} was published by another writer")
    return numbers


def update(spark: SparkSession, path: str, schema: str | StructType, change: Callable[[DataFrame], DataFrame], form: str = "parquet", **options) -> dict[str, int]:
    """Read the current version, change it, and publish the result at the same path."""
    base = latest(spark, path)
    return write(change(read(spark, path, schema)), path, form, base=base, **options)
