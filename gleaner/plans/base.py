"""Registering queries, and inputs that are derived from the tables in both SQL dialects.

The tables hold next to no broken pages, echoes or replies.  So each query derives its
cases from whole tables by arithmetic on keys.  A derivation is one SQL text that Spark
and DuckDB both run, so a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
DERIVED: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """The tables below one folder, and what is derived from them, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.sql(DERIVED[name])

    def sql(self, text: str) -> DataFrame:
        for name in _named(text):
            self(name).createOrReplaceTempView(name)
        return self.spark.sql(text)


def _named(text: str) -> list[str]:
    words = set(re.findall(r"\w+", re.sub("'[^']*'", "", text)))
    return [n for n in (*TABLES, *DERIVED) if n in words]


def _ctes(text: str, done: dict[str, str]) -> dict[str, str]:
    for name in _named(text):
        if name in DERIVED and name not in done:
            _ctes(DERIVED[name], done)
            done[name] = DERIVED[name]
    return done


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under ``name``, with SQL for DuckDB over tables and derivations."""

    def add(run: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: run(Tables(spark, folder))
        if sql is not None:
            heads = ", ".join(f"{n} AS ({s})" for n, s in _ctes(sql, {}).items())
            body = sql.strip()
            if heads and body[:15].upper() == "WITH RECURSIVE ":
                body = f"WITH RECURSIVE {heads}, {body[15:]}"
            elif heads and body[:5].upper() == "WITH ":
                body = f"WITH {heads}, {body[5:]}"
            elif heads:
                body = f"WITH {heads} {body}"
            ORACLE[name] = body
        return run

    return add
