"""The place of each row in a total order, without one task that sees all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_folder


def ordered(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` with ``place`` (from 1) in the order of ``by``, which must be unique.

    Rows are dealt by ranges and stored once, so that ranges stay as they are; a row's place
    is its place in its range plus the rows of all ranges before, of which there is one
    number to a range.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    rows.repartitionByRange(*by).withColumn("range_nr", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    sizes = held.groupBy("range_nr").agg(F.count(F.lit(1)).alias("rows_here"))
    before = sizes.select("range_nr", F.coalesce(F.sum("rows_here").over(Window.orderBy("range_nr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"))
    own = F.row_number().over(Window.partitionBy("range_nr").orderBy(*by))
    return held.withColumn("own_place", own).join(before, "range_nr").withColumn("place", F.col("own_place") + F.col("rows_before")).drop("range_nr", "own_place", "rows_before")
