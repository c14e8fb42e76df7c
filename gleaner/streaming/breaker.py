"""The circuit breaker on a stream of fetch outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import constants as K
from ..operators.circuit import classify, reason
from .ordered import Machine, in_order

NAMES = ("refused", "throttled", "unreachable")


def step(counts: dict[str, int], kind: str | None) -> bool:
    """Count one outcome; whether the breaker opens at it."""
    if kind is None:
        for name in ("throttled", "unreachable"):
            counts[name] = max(0, counts[name] - 1)
        return False
    counts[kind] += 1
    return counts[kind] >= K.BREAKER_LIMITS[kind]


class Breaker(Machine):
    """Each failure with the counters after it, up to the one at which the breaker opens."""

    fields = "kind string, status int, url string"
    kept = "n_refused int, n_throttled int, n_unreachable int, opened boolean"
    out = "seq long, kind string, opened boolean, n_refused int, n_throttled int, n_unreachable int, status int, url string"

    def start(self) -> tuple:
        return 0, 0, 0, False

    def step(self, kept: tuple, at: int, place: int, kind: str | None, status: int | None, url: str | None) -> tuple[tuple, list[tuple]]:
        *numbers, opened = kept
        if opened:
            return kept, []  # what comes after the trip is not counted
        counts = dict(zip(NAMES, numbers, strict=True))
        opened = step(counts, kind)
        now = tuple(counts[n] for n in NAMES)
        return (*now, opened), [(place, kind, opened, *now, status, url)] if kind is not None else []


def watch(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Failures of a stream (run, seq, ts, status, url, body, error) with the counters after each, up to the trip.

    ``reason`` says why it opened, at the trip only.  Events of a run count in the order of ts
    and seq, in whatever batches they come.
    """
    kinds = events.withColumn("kind", classify("status", "body", "error"))
    found = in_order(kinds, "run", "seq", Breaker(), late)
    return found.withColumn("reason", reason("opened"))
