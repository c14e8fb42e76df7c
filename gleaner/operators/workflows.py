"""Plans of agent calls over batches, items and nominated claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import col
from .ordering import ordered


def discover(names: DataFrame, name: str = "name", pattern: str = r"^[^.]") -> DataFrame:
    """The distinct names that fit, with their ``place`` (from 1) in order."""
    return ordered(names.where(F.col(name).rlike(pattern)).select(name).distinct(), name)


def plan_calls(files: DataFrame, file: str, template: str, model: str | None) -> DataFrame:
    return files.select(file, F.replace(F.lit(template), F.lit("{{file}}"), F.col(file)).alias("prompt"), F.lit(model).cast("string").alias("model"))


def unpinned(calls: DataFrame) -> DataFrame:
    """The calls that name no model; a plan with any must not run."""
    return calls.where(F.coalesce("model", F.lit("")) == "")


def nominate(records: DataFrame, field: str, least: int = 1) -> DataFrame:
    """The claims of ``field`` (array of struct(claim, sources)) with enough sources."""
    return records.select(F.explode(field).alias("c")).where(F.size("c.sources") >= least).select("c.claim", "c.sources")


def verdict_error(verdict: Column | str) -> Column:
    """Null for a verdict an agent may give, else what it may give."""
    v = col(verdict)
    return F.when(~F.coalesce(v.isin(K.offered("verify_verdict")), F.lit(False)), F.lit("allowed: " + ", ".join(K.offered("verify_verdict"))))


def verify_calls(claims: DataFrame, model: str | None, label: str = "claim") -> DataFrame:
    """(label, prompt, model, sources) of nominated claims, a call each; what names no model is found by ``unpinned``."""
    return claims.select(F.col("claim").alias(label), verify_prompt("claim").alias("prompt"), F.lit(model).cast("string").alias("model"), F.size("sources").cast("long").alias("sources"))


def dry_run(first: DataFrame, second: str | None = None) -> DataFrame:
    """(stage, calls, unpinned, note) of a chain that isn't run: only its first stage can be planned.

    What a later stage (``second``) would do depends on replies that aren't there, so its numbers
    are null and the note says so.
    """
    none = F.coalesce("model", F.lit("")) == ""
    planned = first.agg(F.count(F.lit(1)).alias("calls"), F.count_if(none).alias("unpinned"))
    one = F.struct(F.lit(1).alias("stage"), "calls", "unpinned", F.lit(None).cast("string").alias("note"))
    two = F.struct(F.lit(2).alias("stage"), F.lit(None).cast("long").alias("calls"), F.lit(None).cast("long").alias("unpinned"), F.lit(second).alias("note"))
    return planned.select(F.inline(F.array(one, two) if second else F.array(one)))


def verify_prompt(claim: Column | str) -> Column:
    return F.concat(
        F.lit('Try to refute this claim with independent primary sources: "'),
        col(claim),
        F.lit('"\nIf the evidence is mixed or stale, answer uncertain; then the original stays and a person decides.'),
    )


def first_success(attempts: DataFrame, item: str, backoff_s: int = K.BACKOFF_S, most: int = K.ATTEMPTS) -> DataFrame:
    """(item, attempt, waited_s): the first attempt that worked; attempt null if none of ``most`` did."""
    tried = attempts.where(F.col("attempt") <= most).groupBy(item).agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("attempt"), F.count(F.lit(1)).alias("_n"))
    return tried.select(item, "attempt", ((F.coalesce("attempt", "_n") - 1) * backoff_s).alias("waited_s"))


def poll_until(snapshots: DataFrame, item: str, hit: Column, most: int = K.POLL_ATTEMPTS, interval_ms: int = K.POLL_INTERVAL_MS) -> DataFrame:
    """(item, attempt, waited_ms) of the first snapshot that hits within the budget; null if none does."""
    first = snapshots.where(F.col("attempt") <= most).groupBy(item).agg(F.min(F.when(hit, F.col("attempt"))).alias("attempt"))
    return first.withColumn("waited_ms", (F.col("attempt") - 1) * interval_ms)


def lock_state(alive: Column, age_minutes: Column, readable: Column) -> Column:
    """held, or why a lock may be taken over."""
    return (
        F.when(~F.coalesce(readable, F.lit(False)), "unreadable")
        .when(~F.coalesce(alive, F.lit(False)), "dead")
        .when(age_minutes > K.LOCK_STALE_MINUTES, "stale")
        .otherwise("held")
    )


def scroll_steps(seen: DataFrame, item: str, preset: str = "text") -> DataFrame:
    """(item, steps): the first step at which the place reached is at or past the height seen then."""
    return seen.groupBy(item).agg(F.min(F.when(F.col("step") * K.SCROLL_STEP_PX[preset] >= F.col("height"), F.col("step"))).alias("steps"))


def gaps(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Rows numbered inside their group; a pause stands before each but the first."""
    nr = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("nr", nr).withColumn("paused", F.col("nr") > 1)


def pauses(rows: DataFrame, group: str, order: str, base_s: float = K.HOST_INTERVAL_S, jitter: float = 0.0) -> DataFrame:
    """``gaps`` with the range a pause may take: ``base_s`` to ``base_s * (1 + jitter)``, and null before the first."""
    found = gaps(rows, group, order)
    paused = lambda s: F.when(F.col("paused"), F.lit(float(s)))
    return found.withColumns({"least_s": paused(base_s), "most_s": paused(base_s * (1 + jitter))})


def drawn(nr: Column, group: Column, low_s: float = K.JITTER_LOW_S, high_s: float = K.JITTER_HIGH_S, seed: int = 0) -> Column:
    """The pause before place ``nr`` of ``group``, between ``low_s`` and ``high_s``; none before the first.

    It is a hash of seed, group and place, so it is the same in every run, whichever task makes it.
    """
    part = F.pmod(F.xxhash64(F.lit(seed), group, nr.cast("long")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.when(nr > 1, F.lit(float(low_s)) + part * F.lit(float(high_s - low_s)))


def drawn_pauses(rows: DataFrame, group: str, order: str, low_s: float = K.JITTER_LOW_S, high_s: float = K.JITTER_HIGH_S, seed: int = 0) -> DataFrame:
    """``gaps`` with ``pause_s``, the pause that is drawn before each row but the first."""
    return gaps(rows, group, order).withColumn("pause_s", drawn(F.col("nr"), F.col(group), low_s, high_s, seed))


def normalize_args(raw: Column | str) -> Column:
    """Arguments as a variant: null is the empty object, a JSON text what it holds."""
    return F.coalesce(F.try_parse_json(col(raw)), F.parse_json(F.lit("{}")))


def cli_arg(arg: Column | str) -> Column:
    """struct(name, value) of ``--name=value``: the value is JSON text where it parses, else a JSON string; a bare ``--name`` is true."""
    arg = col(arg)
    value = F.regexp_extract(arg, "(?s)^--[^=]*=(.*)$", 1)
    parsed = F.to_json(F.try_parse_json(value))
    shown = F.when(~F.contains(arg, F.lit("=")), F.lit("true")).otherwise(F.coalesce(parsed, F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2)))
    return F.struct(F.regexp_extract(arg, "^--([^=]*)", 1).alias("name"), shown.alias("value"))
