"""A circuit breaker over ordered fetch outcomes, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import col, is_challenge_body
from ..sources.store import stored


def classify(status: Column | str, body: Column | str, error: Column | str) -> Column:
    """refused, throttled, unreachable, or null for a success (404 and 500 are answers too)."""
    status = col(status)
    return (
        F.when(is_challenge_body(body) | status.isin(*K.REFUSED_STATUSES), "refused")
        .when(status.isin(*K.THROTTLED_STATUSES), "throttled")
        .when(col(error).isNotNull() | status.isNull() | (status == K.NO_RESPONSE), "unreachable")
    )


def reason(when: Column | str) -> Column:
    """Why the breaker opened, where ``when`` holds: from kind, its counter, status and url."""
    n = F.coalesce(*(F.when(F.col("kind") == name, F.col(f"n_{name}")) for name in K.BREAKER_LIMITS))
    limit = F.coalesce(*(F.when(F.col("kind") == name, F.lit(most)) for name, most in K.BREAKER_LIMITS.items()))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    text = F.concat("kind", F.lit(" "), n, F.lit("x (limit "), limit, F.lit("); last status "), shown(F.col("status")), F.lit(" on "), shown(F.col("url")))
    return F.when(col(when), text)


def counters(events: DataFrame, run: str, order: list[str], kind: str = "kind") -> DataFrame:
    """``events`` with the three counters after each event, as if the breaker never opened.

    A success lowers throttled and unreachable by one, but not under zero: with S the running
    sum of +1 and -1, that is S less the smallest S so far or zero.  Refusals never go down.

    A run may be as long as the table: events are dealt by ranges of run and order and stored, so
    that ranges stay as they are.  S and its smallest are taken inside each range of a run and
    moved by the sum of the ranges before, of which there is one row for each.
    """
    names = ("throttled", "unreachable")
    inside = Window.partitionBy(run, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(run).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = stored(events.repartitionByRange(run, *order).withColumn("_range", F.spark_partition_id()), "circuit-ranges")
    steps = {n: F.when(F.col(kind) == n, 1).when(F.col(kind).isNull(), -1).otherwise(0) for n in names}
    steps["refused"] = F.when(F.col(kind) == "refused", 1).otherwise(0)
    summed = held.withColumns({f"_s_{n}": F.sum(step).over(inside) for n, step in steps.items()})
    summed = summed.withColumns({f"_m_{n}": F.min(f"_s_{n}").over(inside) for n in names})
    least = [F.min(f"_s_{n}").alias(f"_l_{n}") for n in names]
    ranges = summed.withColumns({f"_t_{n}": step for n, step in steps.items()}).groupBy(run, "_range").agg(*(F.sum(f"_t_{n}").alias(f"_t_{n}") for n in steps), *least)
    based = ranges.withColumns({f"_b_{n}": F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)) for n in steps})
    based = based.withColumns({f"_low_{n}": F.least(F.lit(0), F.min(F.col(f"_b_{n}") + F.col(f"_l_{n}")).over(before)) for n in names})
    carried = stored(based.select(F.col(run).alias("_run"), F.col("_range").alias("_nr"), *(f"_b_{n}" for n in steps), *(f"_low_{n}" for n in names)), "circuit-carried")
    both = summed.join(carried, F.col(run).eqNullSafe(F.col("_run")) & (F.col("_range") == F.col("_nr")))
    lowest = lambda n: F.least(f"_low_{n}", F.col(f"_b_{n}") + F.col(f"_m_{n}"))
    counted = [(F.col(f"_b_{n}") + F.col(f"_s_{n}") - lowest(n)).alias(f"n_{n}") for n in names]
    return both.select(*events.columns, *counted, (F.col("_b_refused") + F.col("_s_refused")).alias("n_refused"))


def trips(events: DataFrame, run: str, order: list[str], kind: str = "kind", limits: dict[str, int] | None = None) -> DataFrame:
    """Per run the first event at which a counter reaches its limit: its order columns, kind and counters.

    With status and url of that event, and the reason, where ``events`` has both columns.  Runs
    that stay closed have no row.
    """
    limits = limits or K.BREAKER_LIMITS
    at = F.lit(False)
    for name, limit in limits.items():
        at = at | ((F.col(kind) == name) & (F.col(f"n_{name}") >= limit))
    hit = counters(events, run, order, kind).where(at)
    told = {"status", "url"} <= set(events.columns)
    kept = [kind, "n_refused", "n_throttled", "n_unreachable"] + ["status", "url"] * told
    first = hit.groupBy(run).agg(F.min(F.struct(*order, *kept)).alias("t"))
    found = first.select(run, *(F.col(f"t.{c}").alias(c) for c in [*order, *kept]))
    return found.withColumn("reason", reason(F.lit(True))) if told else found


def summary(events: DataFrame, run: str, order: list[str], kind: str = "kind") -> DataFrame:
    """Per run whether it opened and the failures up to there."""
    found = stored(trips(events, run, order, kind).select(run, F.struct(*order).alias("_t")), "circuit-trips")  # one row to a run
    joined = events.join(found, run, "left")
    counted = joined.where(F.col(kind).isNotNull() & (F.col("_t").isNull() | (F.struct(*order) <= F.col("_t"))))
    return counted.groupBy(run).agg(F.max(F.col("_t").isNotNull()).alias("open"), F.count(F.lit(1)).alias("failures"))
