"""Transcripts folded while their lines still arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import transcripts as T
from .ordered import Machine, in_order


class Fold(Machine):
    """First user text, the first line's agent id and the last assistant turn; given once no line came for ``silence_s``."""

    fields = "spoken string, agent string, turn boolean, stop string, kind string, said string"
    kept = "last long, asked_at long, asked string, first_at long, agent string, turn_at long, stop string, kind string, said string"
    out = "asked string, agent string, turned boolean, stop string, kind string, said string"

    def __init__(self, silence_s: int) -> None:
        self.silence = silence_s * 1_000_000

    def start(self) -> tuple:
        return 0, None, None, None, None, None, None, None, None

    def step(self, kept: tuple, at: int, place: int, spoken, agent, turn, stop, kind, said) -> tuple[tuple, list[tuple]]:
        _, asked_at, asked, first_at, first_agent, turn_at, *last = kept
        if spoken is not None and (asked_at is None or place < asked_at):
            asked_at, asked = place, spoken
        if first_at is None or place < first_at:
            first_at, first_agent = place, agent
        if turn and (turn_at is None or place > turn_at):
            turn_at, last = place, [stop, kind, said]
        return (at, asked_at, asked, first_at, first_agent, turn_at, *last), []

    def ends(self, kept: tuple) -> int | None:
        return kept[0] + self.silence

    def end(self, kept: tuple) -> tuple[None, list[tuple]]:
        _, _, asked, _, agent, turn_at, *last = kept
        return None, [(asked, agent, turn_at is not None, *last)]


def fold(lines: DataFrame, sidecars: DataFrame, late: str = "2 hours", silence_s: int = 600) -> DataFrame:
    """A row per transcript of a stream (path, ts, line_no, value), as the batch operator gives it.

    A transcript is given when none of its lines came for ``silence_s`` of event time.
    ``sidecars`` is a table.
    """
    found = in_order(T.turns(lines), "path", "line_no", Fold(silence_s), late)
    last = F.when(F.col("turned"), F.struct("stop", F.struct(F.col("kind").alias("type"), F.col("said").alias("text")).alias("block")))
    return T.judged(found.withColumn("last", last).drop("turned", "stop", "kind", "said").join(sidecars, "path", "left"))
