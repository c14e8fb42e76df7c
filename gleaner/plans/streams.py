"""Queries on ordered outcomes: the breaker, retries, polls, pacing, and streams over events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import circuit as C
from ..operators import fanout as O
from ..operators import workflows as W
from ..sources import store
from ..sources.store import shared_folder
from ..streaming import attempts, breaker, gate, transcripts, windows
from ..streaming.ordered import started
from . import fanout as _fanout
from .base import DERIVED, query

#: Events as fetch outcomes of a run per user, in the order of time.
DERIVED["outcomes"] = """
    SELECT user_id AS run, ts, event_id, 'http://h' || user_id || '/' || event_id AS url,
        CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 429 WHEN event_type = 'error' THEN 503
            WHEN event_id % 97 = 5 THEN 403 WHEN event_type = 'view' AND value < 20 THEN -1 WHEN event_id % 11 = 0 THEN 404 ELSE 200 END AS status,
        CASE WHEN event_id % 211 = 7 THEN 'Please solve the CAPTCHA' ELSE 'fine' END AS body,
        CASE WHEN event_type = 'view' AND value < 5 THEN 'timed out' END AS error
    FROM events"""

_KIND = """CASE WHEN contains(lower(body), 'captcha') OR status IN (401, 403, 407, 451) THEN 'refused' WHEN status IN (429, 503) THEN 'throttled' WHEN error IS NOT NULL OR status IS NULL OR status = -1 THEN 'unreachable' END"""
_ORDER = "PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING"
_COUNTED = f"""
    kinds AS (SELECT run, ts, event_id, url, status, {_KIND} AS kind FROM outcomes),
    sums AS (SELECT *, sum(CASE WHEN kind = 'throttled' THEN 1 WHEN kind IS NULL THEN -1 ELSE 0 END) OVER w AS st, sum(CASE WHEN kind = 'unreachable' THEN 1 WHEN kind IS NULL THEN -1 ELSE 0 END) OVER w AS su,
        sum(CASE WHEN kind = 'refused' THEN 1 ELSE 0 END) OVER w AS nr FROM kinds WINDOW w AS ({_ORDER})),
    counted AS (SELECT run, ts, event_id, url, status, kind, CAST(st - least(0, min(st) OVER w) AS BIGINT) AS n_throttled, CAST(su - least(0, min(su) OVER w) AS BIGINT) AS n_unreachable, CAST(nr AS BIGINT) AS n_refused FROM sums WINDOW w AS ({_ORDER})),
    hits AS (SELECT * FROM counted WHERE (kind = 'refused' AND n_refused >= 1) OR (kind = 'throttled' AND n_throttled >= 3) OR (kind = 'unreachable' AND n_unreachable >= 5)),
    trips AS (SELECT *, kind || ' ' || CASE kind WHEN 'refused' THEN n_refused WHEN 'throttled' THEN n_throttled ELSE n_unreachable END || 'x (limit ' || CASE kind WHEN 'refused' THEN 1 WHEN 'throttled' THEN 3 ELSE 5 END
        || '); last status ' || coalesce(CAST(status AS VARCHAR), 'none') || ' on ' || url AS reason FROM hits QUALIFY row_number() OVER (PARTITION BY run ORDER BY ts, event_id) = 1)"""


def _kinds(t):
    return t("outcomes").select("run", "ts", "event_id", "status", "url", C.classify("status", "body", "error").alias("kind"))


@query("circuit_classify", f"SELECT event_id, {_KIND} AS kind FROM outcomes")
def _(t):
    return _kinds(t).select("event_id", "kind")


@query("breaker", f"WITH {_COUNTED} SELECT run, event_id, kind, n_refused, n_throttled, n_unreachable, status, url, reason FROM trips")
def _(t):
    return C.trips(_kinds(t), "run", ["ts", "event_id"]).select("run", "event_id", "kind", "n_refused", "n_throttled", "n_unreachable", "status", "url", "reason")


@query("breaker_counters", f"WITH {_COUNTED} SELECT event_id, n_refused, n_throttled, n_unreachable FROM counted")
def _(t):
    return C.counters(_kinds(t), "run", ["ts", "event_id"]).select("event_id", "n_refused", "n_throttled", "n_unreachable")


@query(
    "breaker_summary",
    f"""WITH {_COUNTED} SELECT c.run, count(t.run) > 0 AS open, count(*) AS failures FROM counted c LEFT JOIN trips t ON t.run = c.run
        WHERE c.kind IS NOT NULL AND (t.run IS NULL OR (c.ts, c.event_id) <= (t.ts, t.event_id)) GROUP BY c.run""",
)
def _(t):
    return C.summary(_kinds(t), "run", ["ts", "event_id"])


#: Attempts at an order: its lines in turn, some of which work.
DERIVED["attempts"] = "SELECT l_orderkey AS item, l_linenumber AS attempt, min(l_quantity) < 12 AS ok, min(l_partkey) AS height FROM lineitem GROUP BY l_orderkey, l_linenumber"


DERIVED["harvest_items"] = "SELECT o_orderkey AS id, o_orderkey AS ordinal FROM orders"
DERIVED["harvest_parsed"] = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN 100 ELSE 0 END AS bytes FROM orders WHERE o_orderkey % 5 = 0"
DERIVED["harvest_attempts"] = """
    SELECT 0 AS run, item AS id, item AS at, attempt, ok, CASE WHEN ok THEN 200 ELSE 404 END AS status, 'http://h/' || item AS url, 'fine' AS body, CAST(NULL AS STRING) AS error FROM attempts WHERE item % 7 <> 3"""


@query("retry_flat", "SELECT item, min(attempt) FILTER (ok) AS attempt, CAST((coalesce(min(attempt) FILTER (ok), count(*)) - 1) * 30 AS BIGINT) AS waited_s FROM attempts WHERE attempt <= 3 GROUP BY item")
def _(t):
    return W.first_success(t("attempts"), "item").withColumn("waited_s", F.col("waited_s").cast("long"))


@query("poll_until", "SELECT item, min(attempt) FILTER (ok) AS attempt, (min(attempt) FILTER (ok) - 1) * 2000 AS waited_ms FROM attempts WHERE attempt <= 30 GROUP BY item")
def _(t):
    return W.poll_until(t("attempts"), "item", F.col("ok"))


@query("scroll_steps", "SELECT item, min(attempt) FILTER (attempt * 700 >= height) AS steps FROM attempts GROUP BY item")
def _(t):
    return W.scroll_steps(t("attempts").select("item", F.col("attempt").alias("step"), "height"), "item")


@query("pacing", "SELECT item, count(*) - 1 AS pauses, CAST(count(*) - 1 AS DOUBLE) AS least_s, CAST((count(*) - 1) * 1.5 AS DOUBLE) AS most_s FROM attempts WHERE NOT ok GROUP BY item")
def _(t):
    """A pause before each fetch of an item but the first, of one interval up to half as much again."""
    fetched = W.pauses(t("attempts").where("not ok"), "item", "attempt", jitter=0.5)
    total = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 6).alias(c)
    return fetched.groupBy("item").agg(F.count_if("paused").alias("pauses"), total("least_s"), total("most_s"))


@query("pacing_drawn", "SELECT item, count(*) - 1 AS pauses, true AS within, true AS vary FROM attempts WHERE NOT ok GROUP BY item")
def _(t):
    """The pauses of an item are drawn from the range, not all alike over the table, and the same in every run."""
    drawn = W.drawn_pauses(t("attempts").where("not ok"), "item", "attempt", seed=3)
    again = W.drawn_pauses(t("attempts").where("not ok"), "item", "attempt", seed=3).select("item", "nr", F.col("pause_s").alias("again"))
    within = F.coalesce(F.every(F.col("pause_s").between(K.JITTER_LOW_S, K.JITTER_HIGH_S) & (F.col("pause_s") == F.col("again"))), F.lit(True))
    vary = drawn.agg((F.countDistinct("pause_s") > 10).alias("vary"))
    return drawn.join(again, ["item", "nr"]).groupBy("item").agg(F.count_if("paused").alias("pauses"), within.alias("within")).crossJoin(vary)  # one row


@query(
    "drive",
    """WITH tried AS (SELECT id, min(attempt) FILTER (ok) AS attempt, count(*) AS n FROM harvest_attempts WHERE attempt <= 3 AND id NOT IN (SELECT id FROM harvest_parsed WHERE bytes > 0) GROUP BY id)
        SELECT i.id, CASE WHEN p.id IS NOT NULL THEN 'skipped' WHEN t.attempt IS NOT NULL THEN 'done' WHEN n > 0 THEN 'failed' ELSE 'not reached' END AS state, t.attempt,
            CAST((coalesce(t.attempt, n) - 1) * 30 AS BIGINT) AS waited_s, CASE WHEN t.id IS NOT NULL THEN row_number() OVER (PARTITION BY t.id IS NULL ORDER BY ordinal) > 1 END AS paused
        FROM harvest_items i LEFT JOIN (SELECT id FROM harvest_parsed WHERE bytes > 0) p ON i.id = p.id LEFT JOIN tried t ON i.id = t.id""",
)
def _(t):
    """Items, of which some are parsed already, with the attempts that were made at the others."""
    from ..operators import commands

    outcome, _, _ = commands.drive(t("harvest_items"), t("harvest_attempts"), t("harvest_parsed"), "run", ["at", "attempt"])
    return outcome.select("id", "state", "attempt", F.col("waited_s").cast("long").alias("waited_s"), F.when(F.col("waited_s").isNotNull(), F.col("pause_s").isNotNull()).alias("paused"))


@query("lock_stale", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unreadable' WHEN event_id % 3 = 0 THEN 'dead' WHEN value > 30 THEN 'stale' ELSE 'held' END AS state FROM events")
def _(t):
    return t("events").select("event_id", W.lock_state(F.col("event_id") % 3 != 0, F.col("value"), F.col("event_id") % 5 != 0).alias("state"))


@query(
    "drive_summary",
    """SELECT state, (nr - 1) // 100 AS part, count(*) AS n, sha256(string_agg(CAST(item AS VARCHAR), ',' ORDER BY item)) AS items
       FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY item) AS nr FROM (SELECT item, CASE WHEN item % 10 = 0 THEN 'skipped' WHEN bool_or(ok AND attempt <= 3) THEN 'done' ELSE 'failed' END AS state FROM attempts GROUP BY item)) GROUP BY 1, 2""",
)
def _(t):
    tried = t("attempts").groupBy("item").agg(F.bool_or(F.expr("ok and attempt <= 3")).alias("ok"))
    state = F.when(F.col("item") % 10 == 0, "skipped").when(F.col("ok"), "done").otherwise("failed")
    found = O.drive_summary(tried.withColumn("state", state), size=100)
    return found.select("state", "part", "n", F.sha2(F.array_join(F.transform("items", lambda x: x.cast("string")), ","), 256).alias("items"))


@query("snk_census", "SELECT run, count(*) FILTER (status BETWEEN 200 AND 399) AS ok, count(*) FILTER (status NOT BETWEEN 200 AND 399) AS bad FROM outcomes GROUP BY run")
def _(t):
    """A census of outcomes, persisted and read back."""
    return store.write_census(O.outcome_census(t("outcomes"), "run"), f"{shared_folder(t.spark)}/census-{uuid.uuid4().hex}")


# Streams: a table comes in five batches, in which rows are out of order by up to an hour (orders:
# thirty days), and is read as a file stream until it is used up; the result is a stored table.
# What the last watermark has not passed is not given, on streams as in their SQL.

_BATCHES = 5


def _source(t, rows, ts: str, jitter):
    """``rows`` with ``batch``: five parts of the range of ``ts``, by a time that is up to some seconds later (``jitter``)."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    ends = rows.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    span = max(1, ends["b"] - ends["a"])
    return rows.withColumn("batch", F.least(F.lit(_BATCHES - 1), F.floor((at + jitter * 1_000_000 - ends["a"]) * _BATCHES / span)).cast("int"))


def _stream(t, rows):
    """The rows as a stream of their batches, one after the other."""
    folder = f"{shared_folder(t.spark)}/source-{uuid.uuid4().hex}"
    held, files = rows.drop("batch"), 0
    for nr in range(_BATCHES):
        part = rows.where(F.col("batch") == nr).drop("batch")
        part = part.coalesce(max(1, part.rdd.getNumPartitions() // t.spark.sparkContext.defaultParallelism))
        files = max(files, part.rdd.getNumPartitions())
        part.write.mode("append").parquet(folder)
    return t.spark.readStream.schema(held.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _drained(t, out):
    """What the stream ``out`` gives until its sources are used up."""
    path = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    started(out, path).awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{path}/out")


def _events(t):
    return _stream(t, _source(t, t("events"), "ts", F.col("event_id") % 60 * 60))


_PASSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)"


@query(
    "stream_breaker",
    f"""WITH {_COUNTED}
        SELECT CAST(c.run AS VARCHAR) AS run, c.event_id AS seq, c.kind, t.event_id IS NOT NULL AND c.event_id = t.event_id AS opened,
            CAST(c.n_refused AS INT) AS n_refused, CAST(c.n_throttled AS INT) AS n_throttled, CAST(c.n_unreachable AS INT) AS n_unreachable,
            CASE WHEN c.event_id = t.event_id THEN t.reason END AS reason
        FROM counted c LEFT JOIN trips t ON t.run = c.run WHERE c.kind IS NOT NULL AND (t.run IS NULL OR (c.ts, c.event_id) <= (t.ts, t.event_id)) AND c.ts <= {_PASSED}""",
)
def _(t):
    """The batch operator's counters on a stream, whatever batches the rows come in."""
    rows = _source(t, t("outcomes").withColumnRenamed("event_id", "seq"), "ts", F.col("seq") % 60 * 60)
    return _drained(t, breaker.watch(_stream(t, rows))).drop("status", "url")


#: Orders of a customer as attempts: pauses of days, a month of disorder.
DERIVED["order_attempts"] = """
    SELECT o_custkey AS item, o_orderdate AS ts, o_orderkey AS attempt, o_totalprice > 150000 AS ok, o_orderpriority = '1-URGENT' AS hit FROM orders"""
_LATE, _BACKOFF, _TIMEOUT, _POLLS = "60 days", 5 * 86400, 200 * 86400, 4
_SEQUENCE = """
    seq AS (SELECT item, epoch(ts) AS tick, attempt, ok, hit, row_number() OVER w AS k, lag(epoch(ts)) OVER w AS before, first_value(epoch(ts)) OVER w AS began
        FROM order_attempts WINDOW w AS (PARTITION BY item ORDER BY ts, attempt)),
    passed AS (SELECT epoch(max(ts)) - 60 * 86400 AS until FROM order_attempts)"""


def _order_attempts(t):
    return _stream(t, _source(t, t("order_attempts"), "ts", F.col("attempt") % 30 * 86400))


@query(
    "stream_retry",
    f"""WITH {_SEQUENCE},
        decided AS (
            SELECT item, k, CASE WHEN tick - before > {_BACKOFF + _TIMEOUT} THEN 'silent' WHEN ok THEN 'done' WHEN k = 3 THEN 'failed' END AS state,
                CASE WHEN tick - before > {_BACKOFF + _TIMEOUT} THEN before + {_BACKOFF + _TIMEOUT} ELSE tick END AS decided_at FROM seq
            UNION ALL SELECT item, max(k) + 1, 'silent', max(tick) + {_BACKOFF + _TIMEOUT} FROM seq GROUP BY item),
        first AS (SELECT * FROM decided WHERE state IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item ORDER BY k) = 1)
        SELECT CAST(item AS VARCHAR) AS item, CASE WHEN state = 'done' THEN CAST(k AS INT) END AS attempt,
            CAST((k - CASE WHEN state = 'silent' THEN 2 ELSE 1 END) * {_BACKOFF} AS BIGINT) AS waited_s, state
        FROM first, passed WHERE decided_at <= until""",
)
def _(t):
    """A customer's orders as attempts of which a large one works."""
    return _drained(t, attempts.first_success(_order_attempts(t), "item", _LATE, 3, _BACKOFF, _TIMEOUT))


@query(
    "stream_poll",
    f"""WITH {_SEQUENCE},
        decided AS (
            SELECT item, k, tick, CASE WHEN tick > began + {_POLLS * 86400 * 100} THEN 'over' WHEN hit THEN 'hit' WHEN k = {_POLLS} THEN 'over' END AS state, began FROM seq
            UNION ALL SELECT item, max(k) + 1, NULL, 'over', min(began) FROM seq GROUP BY item),
        first AS (SELECT * FROM decided WHERE state IS NOT NULL QUALIFY row_number() OVER (PARTITION BY item ORDER BY k) = 1)
        SELECT CAST(item AS VARCHAR) AS item, CASE WHEN state = 'hit' THEN CAST(k AS INT) END AS attempt, CASE WHEN state = 'hit' THEN CAST((k - 1) * {100 * 86_400_000} AS BIGINT) END AS waited_ms
        FROM first, passed WHERE least(coalesce(tick, 1e18), began + {_POLLS * 86400 * 100}) <= until""",
)
def _(t):
    """A customer's orders as polls that wait for an urgent one; a timer ends those that never see it."""
    return _drained(t, attempts.poll_until(_order_attempts(t), "item", _LATE, _POLLS, 100 * 86_400_000))


@query(
    "stream_transcripts",
    f"""WITH {_fanout._FOLD}, ends AS (SELECT path, max(conv_id * 600 + line_no) AS tick FROM transcript_lines WHERE conv_id % 7 <> 6 GROUP BY path)
        SELECT path, agent_id, target, identified_by, text, complete, reason FROM folded JOIN ends USING (path) WHERE tick + 60 <= (SELECT max(tick) - 3600 FROM ends)""",
)
def _(t):
    """Conversations that begin ten minutes after each other, with lines out of order; a minute of silence ends one."""
    lines = t("transcript_lines").withColumn("ts", F.timestamp_seconds(86400 + F.col("conv_id") * 600 + F.col("line_no")))
    rows = _source(t, lines, "ts", F.col("line_no") * 7 % 50 * 60)
    return _drained(t, transcripts.fold(_stream(t, rows), t("transcript_sidecars"), "1 hour", 60))


DERIVED["sent_out"] = "SELECT o_orderkey AS id, o_orderdate AS ts FROM orders"
DERIVED["came_back"] = """
    SELECT CASE WHEN o_orderkey % 11 = 0 THEN -o_orderkey ELSE o_orderkey END AS id, o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 90 AS INT) AS ts FROM orders WHERE o_orderkey % 5 <> 0"""


@query(
    "stream_gate",
    """WITH passed AS (SELECT least((SELECT max(ts) FROM sent_out), (SELECT max(ts) FROM came_back)) - INTERVAL 60 DAY - INTERVAL 6 HOUR AS until),
        joined AS (SELECT s.id AS asked, r.id AS made, s.ts AS asked_at, r.ts AS made_at FROM sent_out s FULL JOIN came_back r ON s.id = r.id AND r.ts >= s.ts AND r.ts <= s.ts + INTERVAL 60 DAY + INTERVAL 12 HOUR)
        SELECT coalesce(asked, made) AS id, CASE WHEN asked IS NULL THEN 'extra' WHEN made IS NULL THEN 'missing' ELSE 'matched' END AS class FROM joined, passed
        WHERE (asked IS NOT NULL AND made IS NOT NULL) OR (made IS NULL AND asked_at + INTERVAL 60 DAY + INTERVAL 12 HOUR < until) OR (asked IS NULL AND made_at < until)""",
)
def _(t):
    """Orders as questions, and answers up to three months later; what has no answer after sixty days is missing."""
    sent, back = (_stream(t, _source(t, t(name), "ts", F.abs("id") % 30 * 86400)) for name in ("sent_out", "came_back"))
    return _drained(t, gate.census_gate(sent, back, "60 days 12 hours", "60 days 6 hours")).select("id", "class")


@query("stream_dedup", "SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 5 = 1 AND ts < (SELECT min(ts) + INTERVAL 4 DAY FROM events)")
def _(t):
    """Events that come twice: ten minutes later (dropped), weeks later under their old time (late) or under a new one (given again)."""
    events = _source(t, t("events"), "ts", F.col("event_id") % 60 * 60)
    early = events.where(F.col("ts") < F.lit(events.agg(F.min("ts")).first()[0]) + F.expr("interval 4 days"))
    soon = _source(t, t("events").where("event_id % 4 = 0").withColumn("ts", F.expr("ts + interval 10 minutes")), "ts", F.lit(0))
    new = early.where("event_id % 5 = 1").withColumns({"ts": F.expr("ts + interval 18 days"), "batch": F.lit(3)})
    late = early.where("event_id % 5 = 2").withColumn("batch", F.lit(_BATCHES - 1))
    return _drained(t, windows.deduplicated(_stream(t, events.union(soon).union(new).union(late))).select("event_id"))


@query("stream_tumbling", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS starts, event_type, count(*) AS n FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= {_PASSED} GROUP BY 1, 2")
def _(t):
    return _drained(t, windows.tumbling(_events(t))).select(F.col("starts").cast("timestamp_ntz").alias("starts"), "event_type", "n")


@query("stream_sessions")
def _(t):
    return _drained(t, windows.sessions(_events(t)))
