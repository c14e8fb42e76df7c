"""Retries and polls on streams of attempts; what never works ends by a timer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import constants as K
from .ordered import Machine, in_order

SECOND = 1_000_000


class Retry(Machine):
    """The first of ``most`` attempts that works; the end is the last that may be made, or silence."""

    fields = "ok boolean"
    kept = "tried int, last long, done boolean"
    out = "attempt int, waited_s long, state string"

    def __init__(self, most: int, backoff_s: int, timeout_s: int) -> None:
        self.most, self.backoff, self.silence = most, backoff_s, (timeout_s + backoff_s) * SECOND

    def start(self) -> tuple:
        return 0, 0, False

    def step(self, kept: tuple, at: int, place: int, ok: bool | None) -> tuple[tuple, list[tuple]]:
        tried, _, done = kept
        if done:
            return kept, []
        tried += 1
        if ok:
            return (tried, at, True), [(tried, (tried - 1) * self.backoff, "done")]
        if tried >= self.most:
            return (tried, at, True), [(None, (tried - 1) * self.backoff, "failed")]
        return (tried, at, False), []

    def ends(self, kept: tuple) -> int | None:
        tried, last, done = kept
        return None if done else last + self.silence

    def end(self, kept: tuple) -> tuple[tuple, list[tuple]]:
        tried, last, _ = kept
        return (tried, last, True), [(None, (tried - 1) * self.backoff, "silent")]


class Poll(Machine):
    """The first snapshot that hits, or none once the budget of polls is over."""

    fields = "hit boolean"
    kept = "began long, seen int, done boolean"
    out = "attempt int, waited_ms long"

    def __init__(self, most: int, interval_ms: int) -> None:
        self.most, self.interval = most, interval_ms

    def start(self) -> tuple:
        return -1, 0, False

    def step(self, kept: tuple, at: int, place: int, hit: bool | None) -> tuple[tuple, list[tuple]]:
        began, seen, done = kept
        if done:
            return kept, []
        began, seen = at if seen == 0 else began, seen + 1
        if hit:
            return (began, seen, True), [(seen, (seen - 1) * self.interval)]
        if seen >= self.most:
            return (began, seen, True), [(None, None)]
        return (began, seen, False), []

    def ends(self, kept: tuple) -> int | None:
        began, _, done = kept
        return None if done else began + self.most * self.interval * 1000

    def end(self, kept: tuple) -> tuple[tuple, list[tuple]]:
        began, seen, _ = kept
        return (began, seen, True), [(None, None)]


def first_success(attempts: DataFrame, item: str, late: str = "2 hours", most: int = K.ATTEMPTS, backoff_s: int = K.BACKOFF_S, timeout_s: int = K.ATTEMPT_TIMEOUT_S) -> DataFrame:
    """(item, attempt, waited_s, state) of a stream (item, ts, attempt, ok).

    state: ``done``; ``failed`` after the last attempt; ``silent`` if none follows within the
    timeout and the pause, in event time.
    """
    return in_order(attempts, item, "attempt", Retry(most, backoff_s, timeout_s), late)


def poll_until(snapshots: DataFrame, item: str, late: str = "2 hours", most: int = K.POLL_ATTEMPTS, interval_ms: int = K.POLL_INTERVAL_MS) -> DataFrame:
    """(item, attempt, waited_ms) of a stream of snapshots (item, ts, attempt, hit); nulls where none hits in time."""
    return in_order(snapshots, item, "attempt", Poll(most, interval_ms), late)


class Scroll(Machine):
    """The first step at which the place reached is at or past the height seen then; none once no step came for a while."""

    fields = "height long"
    kept = "last long, done boolean"
    out = "steps long"

    def __init__(self, step_px: int, silence_s: int) -> None:
        self.step_px, self.silence = step_px, silence_s * SECOND

    def start(self) -> tuple:
        return 0, False

    def step(self, kept: tuple, at: int, place: int, height: int | None) -> tuple[tuple, list[tuple]]:
        if kept[1]:
            return kept, []
        reached = height is not None and place * self.step_px >= height
        return (at, reached), [(place,)] if reached else []

    def ends(self, kept: tuple) -> int | None:
        return None if kept[1] else kept[0] + self.silence

    def end(self, kept: tuple) -> tuple[tuple, list[tuple]]:
        return (kept[0], True), [(None,)]


def scroll_steps(seen: DataFrame, item: str, late: str = "2 hours", preset: str = "text", silence_s: int = 60) -> DataFrame:
    """(item, steps) of a stream of steps (item, ts, step, height); null where the end was not reached within the silence."""
    return in_order(seen, item, "step", Scroll(K.SCROLL_STEP_PX[preset], silence_s), late)
