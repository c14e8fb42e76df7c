"""Link states: stickiness, the probe ladder, and merges in which each writer owns its columns."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import urls as U
from ..functions.text import col
from ..sources.store import stored
from .fanout import lists
from .ordering import ordered

TOP_KEYS = ("http_status", "last_checked", "verdicts", "verified_via")
VERDICT_KEYS = ("content_status", "semantic_verified_at", "notes")


def is_live(status: Column | str) -> Column:
    return F.coalesce(col(status).isin(*K.LIVE_STATUSES), F.lit(False))


def is_sticky(verified_via: Column | str, status: Column | str) -> Column:
    """Confirmed by rendering, and live when it was."""
    return F.coalesce(col(verified_via) == K.STICKY_MARKER, F.lit(False)) & is_live(status)


def is_tls_error(*texts: Column | str) -> Column:
    found = F.lit(False)
    for t in texts:
        low = F.lower(F.coalesce(col(t), F.lit("")))
        found = found | F.contains(low, F.lit("certificate")) | F.contains(low, F.lit("ssl"))
    return found


def ladder(head: Column, head_relaxed: Column, head_tls: Column, get: Column, get_relaxed: Column, get_tls: Column) -> Column:
    """The status of a probe: HEAD, then GET unless HEAD is live; each is tried unverified after a TLS error."""
    failed = F.lit(K.NO_RESPONSE)
    step = lambda strict, relaxed, tls: F.coalesce(strict, F.when(tls, relaxed), failed)
    first = step(head, head_relaxed, head_tls)
    return F.when(is_live(first), first).otherwise(step(get, get_relaxed, get_tls))


def resolve(states: DataFrame, probed: DataFrame) -> DataFrame:
    """(url, status, probed): a sticky link keeps its recorded status, any other takes the probe's."""
    sticky = is_sticky("verified_via", "http_status")
    joined = states.join(probed.select("url", F.col("status").alias("_s")), "url", "left")
    return joined.select("url", F.when(sticky, F.col("http_status")).otherwise(F.coalesce("_s", F.lit(K.NO_RESPONSE))).alias("status"), (~sticky).alias("probed"))


def merge_http(states: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert http_status and last_checked by url; all other columns stay as they are."""
    new = updates.select("url", F.col("http_status").alias("_s"), F.col("last_checked").alias("_c"))
    joined = states.join(new, "url", "full")
    return joined.select(
        *(
            F.coalesce("_s", "http_status").alias(c) if c == "http_status" else F.coalesce("_c", "last_checked").alias(c) if c == "last_checked" else F.col(c)
            for c in states.columns
        )
    )


def merge_verdicts(states: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert one kind of verdict by url in the map ``verdicts``; other kinds and columns stay."""
    new = updates.select("url", F.col("kind").alias("_k"), F.col("verdict").alias("_v"))
    joined = states.join(new, "url", "full")
    old = F.map_filter(F.col("verdicts"), lambda k, _: k != F.col("_k"))
    merged = (
        F.when(F.col("_k").isNull(), F.col("verdicts"))
        .when(F.col("verdicts").isNull(), F.create_map("_k", "_v"))
        .otherwise(F.map_concat(old, F.create_map("_k", "_v")))
    )
    return joined.select(*(merged.alias(c) if c == "verdicts" else F.col(c) for c in states.columns))


def host_buckets(links: DataFrame, ordinal: str, size: int = K.LIST_SIZE) -> DataFrame:
    """(host, part, n, urls): the addresses of each host in order, in lists of at most ``size``."""
    hosts = links.select(U.host("url").alias("host"), ordinal, "url")
    return lists(hosts, "host", ordinal, "url", size).withColumnRenamed("values", "urls")


def longest_first(counts: dict[int, int], slots: int, interval_s: float) -> dict[int, list[float]]:
    """When queues begin on ``slots`` of which each takes one at a time, the longest queues first.

    ``counts``: how many queues there are of each number of links.  Of the queues of a number, rank r
    begins at ``starts[r]``; behind the last, ranks go on in rounds of ``slots``, each by the time
    of a queue later.  A queue takes an interval between two links.  Queues of a number are taken
    one by one only until the slots are as near to each other as one queue is long; from then on a
    round takes each slot once, so the work is by distinct numbers, not by queues.
    """
    free = [0.0] * slots
    plan = {}
    for n in sorted(counts, reverse=True):
        taken, starts, left = (n - 1) * interval_s, [], counts[n]

        def take() -> None:
            starts.append(free[0])
            heapq.heapreplace(free, free[0] + taken)

        while left and (max(free) - free[0] > taken or (taken == 0 and not starts)):
            if taken == 0:  # nothing takes time: all begin where the first slot is free
                starts, left = [free[0]] * slots, 0
                break
            take()
            left -= 1
        for _ in range(min(left, slots)):
            take()
            left -= 1
        rounds, rest = divmod(left, slots)
        free = [x + rounds * taken for x in free]
        for _ in range(rest):
            heapq.heapreplace(free, free[0] + taken)
        plan[n] = starts
    return plan


def host_plan(links: DataFrame, ordinal: str, interval_s: float = K.HOST_INTERVAL_S, max_hosts: int = K.MAX_HOSTS) -> DataFrame:
    """``links`` with host, its ``slot`` in the host's serial queue, and ``starts_s``, in seconds from the begin of all.

    Hosts run side by side, at most ``max_hosts`` at once, those with most links first (of equal ones
    the one that is seen first); links of a host follow each other by an interval.  The makespan is
    the largest ``starts_s``.  Places are counted by ranges, so no task holds a host or all hosts; the
    driver holds the distinct numbers of links of hosts, at most about twice the root of all links.
    """
    spark = links.sparkSession
    hosted = links.withColumn("host", F.coalesce(U.host("url"), F.lit("")))
    placed = ordered(hosted, "host", ordinal)
    queues = stored(placed.groupBy(F.col("host").alias("_h")).agg(F.count(F.lit(1)).alias("_n"), F.min("place").alias("_first"), F.min(ordinal).alias("_seen")), "host-queues")
    counts = {r["_n"]: r["n"] for r in queues.groupBy("_n").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = max(1, min(max_hosts, sum(counts.values())))
    plan = longest_first(counts, slots, interval_s)
    before, first_rank = 0, {}
    for n in sorted(counts, reverse=True):
        first_rank[n], before = before, before + counts[n]
    rows = [(n, first_rank[n], starts) for n, starts in plan.items()]
    begins = spark.createDataFrame(rows, "_n long, _before long, _starts array<double>")
    ranked = ordered(queues.withColumn("_minus", -F.col("_n")), "_minus", "_seen", "_h").withColumnRenamed("place", "_place").join(begins, "_n")
    rank, size = F.col("_place") - 1 - F.col("_before"), F.size("_starts")
    beyond = rank - size
    periodic = F.get("_starts", (size - slots + F.pmod(beyond, F.lit(slots))).cast("int")) + (F.floor(beyond / slots) + 1) * (F.col("_n") - 1) * F.lit(interval_s)
    begin = F.when(rank < size, F.get("_starts", rank.cast("int"))).otherwise(periodic)
    queue = ranked.select("_h", "_first", begin.alias("_begin"))
    slot = F.col("place") - F.col("_first")
    return placed.join(queue, F.col("host") == F.col("_h")).select(*(c for c in hosted.columns), slot.alias("slot"), (F.col("_begin") + slot * F.lit(float(interval_s))).alias("starts_s"))


def schema_problems(states: DataFrame) -> DataFrame:
    """(url, pos, problem) for ``states`` (url, keys, verified_via, verdicts map of struct(keys, content_status))."""
    extra = F.array_sort(F.array_except("keys", F.array(*map(F.lit, TOP_KEYS))))
    top = F.array_compact(
        F.array(
            F.when(F.size(extra) > 0, F.concat(F.lit("unknown top-level keys "), F.array_join(extra, ", "))),
            F.when(F.col("verified_via") != K.STICKY_MARKER, F.concat(F.lit("unknown verified_via "), F.col("verified_via"))),
        )
    )

    def verdict(e: Column) -> Column:
        kind, v = e["key"], e["value"]
        more = F.array_sort(F.array_except(v["keys"], F.array(*map(F.lit, VERDICT_KEYS))))
        bad = ~F.coalesce(v["content_status"].isin(K.accepted("content_status")), F.lit(False))
        return F.array_compact(
            F.array(
                F.when(F.size(more) > 0, F.concat(F.lit("["), kind, F.lit("] unknown verdict keys "), F.array_join(more, ", "))),
                F.when(bad, F.concat(F.lit("["), kind, F.lit("] unknown content_status "), F.coalesce(v["content_status"], F.lit("none")))),
            )
        )

    inner = F.coalesce(F.flatten(F.transform(F.map_entries("verdicts"), verdict)), F.array().cast("array<string>"))
    return states.select("url", F.posexplode(F.concat(top, inner)).alias("pos", "problem"))
