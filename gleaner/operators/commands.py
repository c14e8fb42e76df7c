"""Whole tasks over tables, each a chain of operators; exit codes are columns of one-row results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import readers, store, versions
from . import circuit, compose, fanout, linkstate, quality, transcripts, workflows
from .ordering import ordered

OK, ERROR = 0, 1


def sweep(states: DataFrame, probed: DataFrame, checked: str) -> DataFrame:
    """Link states after a probe: sticky links keep their status, every other takes the probe's; all are stamped."""
    resolved = linkstate.resolve(states, probed)
    updates = resolved.select("url", F.col("status").alias("http_status"), F.lit(checked).alias("last_checked"))
    return linkstate.merge_http(states, updates)


#: What a sweep keeps of a link.
STATE = "http_status: int, last_checked: string, verified_via: string, verdicts: map<string, struct<content_status: string, semantic_verified_at: string, notes: string>>"


def sweep_files(spark: SparkSession, path: str, probed: DataFrame, checked: str, fields: str = STATE) -> dict[str, int]:
    """``sweep`` over the states at ``path``, in place: its current version is read and the next one written."""
    base = versions.latest(spark, path)
    return store.write_states(sweep(readers.link_states(spark, path, fields), probed, checked), path, base)


def plan(worklist: DataFrame, done: DataFrame, template: str, values: dict[str, Column], run: str, reverify: bool = False, only: list[str] | None = None) -> DataFrame:
    """(id, block, error): the prompt of each pending item (of those in ``only``, if given), framed for sending."""
    items = fanout.pending(worklist, done, reverify=reverify)
    if only is not None:
        items = items.where(F.col("id").isin(only))
    filled = items.select("*", compose.fill(F.lit(template), values).alias("_f"))
    return filled.select("id", compose.block(F.col("_f.text"), F.col("id"), F.lit(run)).alias("block"), F.col("_f.error").alias("error"))


def ingest(replies: DataFrame, agents: DataFrame, worklist: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records that were asked for, census against the work-list, ledger of all replies)."""
    found = fanout.ledger(replies, agents, **options)
    records = fanout.applied(found).withColumnRenamed("item_id", "id")
    return fanout.strict_join(worklist, records), fanout.census_gate(worklist, records), found


def ingest_exit(census: DataFrame, found: DataFrame) -> DataFrame:
    """0 only if no reply was rejected and the census is clean."""
    rejected = found.agg(F.count_if(F.col("bucket") != "applied").alias("rejected"))
    clean = fanout.census_rollup(census)
    both = rejected.crossJoin(clean)  # one row each
    return both.select(F.when((F.col("rejected") == 0) & F.col("ok"), F.lit(OK)).otherwise(F.lit(ERROR)).alias("exit_code"))


def find_transcripts(lines: DataFrame, sidecars: DataFrame, agents: list[str] | None = None, project: str | None = None, session: str | None = None) -> DataFrame:
    """Folded transcripts: of paths that hold ``project`` and ``session``, and agents that begin with one of ``agents``, if given.

    Paths are told apart before anything is folded.
    """
    for part in (project, session):
        if part:
            lines = lines.where(F.contains("path", F.lit(part)))
    folded = transcripts.fold(lines, sidecars)
    if agents:
        wanted = F.lit(False)
        for a in agents:
            wanted = wanted | F.startswith("agent_id", F.lit(a))
        folded = folded.where(wanted)
    return folded


def recover(lines: DataFrame, sidecars: DataFrame, agents: list[str] | None = None, project: str | None = None, session: str | None = None) -> DataFrame:
    """Replies in finished transcripts, of those that ``find_transcripts`` finds."""
    return transcripts.to_results(find_transcripts(lines, sidecars, agents, project, session))


def drive(items: DataFrame, attempts: DataFrame, parsed: DataFrame, run: str, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A harvest as its attempts tell it: (outcome of each item, its lists, where runs had to stop).

    ``items`` (id, ordinal), ``attempts`` (run, id, attempt, ok, status, url, body, error and ``order``),
    ``parsed`` (id, bytes).  An item with a parsed record is skipped, without an attempt or a pause.  What
    comes after a run's breaker opened was not made.  Of the others up to three attempts count; one
    that never worked is failed, and the rest goes on.  ``waited_s`` is the time between attempts and
    ``pause_s`` the pause before the first, none before the first item that is fetched.
    """
    kinds = attempts.withColumn("kind", circuit.classify("status", "body", "error"))
    stops = store.stored(circuit.trips(kinds, run, order), "drive-stops")  # of known size, so a run of very many attempts isn't dealt by its name
    made = attempts.join(stops.select(run, F.struct(*order).alias("_stop")), run, "left").where(F.col("_stop").isNull() | (F.struct(*order) <= F.col("_stop")))
    have = parsed.where("bytes > 0").select("id").distinct().withColumn("skipped", F.lit(True))
    todo = items.join(have, "id", "left")
    tried = workflows.first_success(made.join(todo.where("skipped is null").select("id"), "id", "left_semi"), "id")
    fetched = todo.where("skipped is null").select("id", "ordinal").join(tried, "id")
    paced = ordered(fetched.select("id", "ordinal", "attempt", "waited_s"), "ordinal", "id")
    paced = paced.select("id", "attempt", "waited_s", workflows.drawn(F.col("place"), F.lit("")).alias("pause_s"))
    state = F.when(F.col("skipped"), "skipped").when(F.col("attempt").isNotNull(), "done").when(F.col("waited_s").isNotNull(), "failed").otherwise("not reached")
    outcome = todo.join(paced, "id", "left").select("id", "ordinal", state.alias("state"), "attempt", "waited_s", "pause_s")
    return outcome, fanout.drive_summary(outcome, "id", "state"), stops


def qa_exit(findings: DataFrame) -> DataFrame:
    return findings.agg(F.when(F.count(F.lit(1)) > 0, F.lit(ERROR)).otherwise(F.lit(OK)).alias("exit_code"))


def qa_census(records: DataFrame, fields: list[str], floor: float = 0.5) -> DataFrame:
    return quality.thin(quality.field_census(records, fields), floor)


def qa_agree(pass_a: DataFrame, pass_b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return quality.agreement(pass_a, pass_b, key, dict.fromkeys(fields)).where(F.col("class") == "disputed")


def qa_echo(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return quality.echo_scan(records, key, fields)


def qa_soft(pages: DataFrame) -> DataFrame:
    return quality.soft_errors(pages).where("suspect")


def stop_points(outcomes: DataFrame, run: str, order: list[str]) -> DataFrame:
    """Where a harvest's breaker opens, run by run."""
    kinds = outcomes.withColumn("kind", circuit.classify("status", "body", "error"))
    return circuit.trips(kinds, run, order)
