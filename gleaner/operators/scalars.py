"""Reported measurements against stored counts, and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import col, reasons


def measurement_error(payload: Column | str, item_id: Column) -> Column:
    """Why a measurement (JSON text) is refused; null if it is good."""
    p = col(payload)
    ident = F.coalesce(F.nullif(F.get_json_object(p, "$.item_id"), F.lit("")), item_id)
    status = F.get_json_object(p, "$.status")
    shape = F.coalesce(F.schema_of_variant(F.try_variant_get(F.try_parse_json(p), "$.source_count", "variant")), F.lit("BIGINT"))
    count = F.get_json_object(p, "$.source_count")
    return (
        F.when(ident.isNull() | (ident == ""), "no item_id")
        .when(status.isNull(), "no status")
        .when(status.isin(K.derived("coverage_status")), "derived status")
        .when(~status.isin(K.accepted("coverage_status")), "unknown status")
        .when(shape != "BIGINT", "source_count must be an integer")
        .when(count.try_cast("long") < 0, "source_count is negative")
    )


def assess(status: Column, source: Column, stored: Column, threshold: float = K.COVERAGE_THRESHOLD) -> Column:
    """struct(ratio, verdict): what could not be measured is unknown (manual), never complete."""
    ratio = stored / F.nullif(source, F.lit(0))
    measured = (status == "ok") & (source > 0)
    verdict = F.when(stored.isNull() | ~measured, "manual").when(ratio >= threshold, "ok").otherwise("undercoverage")
    return F.struct(F.when(measured & stored.isNotNull(), ratio).alias("ratio"), verdict.alias("verdict"))


def assess_all(measured: DataFrame, stored: DataFrame, key: str = "item_id", threshold: float = K.COVERAGE_THRESHOLD) -> DataFrame:
    """``measured`` (item, status, source_count) with stored_count, ratio and verdict; no stored count is manual."""
    joined = measured.join(stored, key, "left")
    found = joined.withColumn("_a", assess(F.col("status"), F.col("source_count"), F.col("stored_count"), threshold))
    return found.select(*measured.columns, F.coalesce("stored_count", F.lit(0)).alias("stored_count"), F.col("_a.ratio").alias("ratio"), F.col("_a.verdict").alias("verdict"))


def verdict_counts(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def vocabulary_error(value: Column | str, name: str, from_agent: bool = False, where: str = "") -> Column:
    """Why a value is outside a closed vocabulary; null if it is inside or missing."""
    v, prefix = col(value), f"{where}: " if where else ""
    allowed = sorted(K.offered(name) if from_agent else K.accepted(name))
    text = F.concat(F.lit(f"{prefix}unknown {name} '"), v, F.lit("'; allowed: " + ", ".join(allowed)))
    if from_agent and K.derived(name):
        claimed = F.concat(F.lit(prefix + "'"), v, F.lit("' is derived by the caller, not reported by an agent; allowed: " + ", ".join(allowed)))
        text = F.when(v.isin(K.derived(name)), claimed).otherwise(text)
    return F.when(~v.isin(allowed), text)


def record_problems(fields: dict[str, str], from_agent: bool = False) -> Column:
    """All vocabulary errors of a record; ``fields`` gives each field's vocabulary."""
    return reasons(*((vocabulary_error(f, name, from_agent, f).isNotNull(), vocabulary_error(f, name, from_agent, f)) for f, name in fields.items()))


def tie_break(verdict: Column | str) -> Column:
    """struct(keep_original, flag_for_human): an uncertain verdict keeps the original and asks a person."""
    uncertain = col(verdict) == "uncertain"
    return F.struct(uncertain.alias("keep_original"), uncertain.alias("flag_for_human"))
