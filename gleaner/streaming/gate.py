"""The census gate on two streams: what was sent out, and what came back.

Both streams are one with a mark of the side, and keys are dealt into ``BUCKETS`` by their hash.
A bucket's rows that wait for a watermark are one value of the state store, a table, so the store
is called a few times for each bucket and batch and never for a row; rows meet as columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: Groups of keys in the state store; a checkpoint holds for one number only.
BUCKETS = 512
ASKED, MADE = 0, 1
#: No time.
_NONE = -(1 << 63)


def _folded(t: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    found = pa.Table.from_pandas(t, preserve_index=False)
    with pa.ipc.new_stream(sink, found.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(found)
    return sink.getvalue().to_pybytes()


def _unfolded(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


class _Gate(StatefulProcessor):
    """What a bucket holds: ``side``, ``key``, ``at``; ``told``: matched, missing or extra already; ``over``: past its end; ``known``: repeats of it don't count."""

    def __init__(self, deadline: int, late: int) -> None:
        self.deadline, self.late = deadline, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")

    def _keep(self, t: pd.DataFrame) -> None:
        """Store what still waits for something, and set the timer for the first of it."""
        due = self._due(t)
        t = t[due < np.iinfo(np.int64).max]
        if not len(t):
            self.held.clear()
            return
        self.held.update((_folded(t),))
        self.handle.registerTimer(int(due.min()) // 1000 + 1)  # the first millisecond that has passed it

    def _due(self, t: pd.DataFrame) -> np.ndarray:
        """The time of each row that a watermark has to pass next."""
        at, side = t["at"].to_numpy(), t["side"].to_numpy()
        never = np.iinfo(np.int64).max
        repeats = np.where(t["known"].to_numpy(), at + self.late, never)
        ends = np.where(side == ASKED, at + self.deadline, at)
        # A question that was answered may be answered again up to the deadline; an answer may yet meet a question up to its time.
        return np.minimum(repeats, np.where(t["over"].to_numpy(), never, ends))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([r[["side", "key", "at"]] for r in rows], ignore_index=True)
        new = new.sort_values("at", kind="stable").drop_duplicates(["side", "key"]).assign(told=False, known=True, over=False)
        state = self.held.get()
        old = _unfolded(state[0]) if state is not None else new.iloc[:0]
        if len(old):
            before = old.loc[old["known"], ["side", "key"]]
            again = new[["side", "key"]].merge(before.drop_duplicates(), on=["side", "key"], how="left", indicator=True)["_merge"].to_numpy() == "both"
            new = new[~again]
        t = pd.concat([old, new], ignore_index=True) if len(old) else new.reset_index(drop=True)
        fresh = np.arange(len(t)) >= len(old)
        placed = t.assign(place=np.arange(len(t)), fresh=fresh)[["side", "key", "at", "place", "fresh"]]
        asked, made = (placed[placed["side"] == side].drop(columns="side") for side in (ASKED, MADE))
        pairs = asked.merge(made, on="key", suffixes=("", "_made"))
        within = (pairs["at_made"] >= pairs["at"]) & (pairs["at_made"] <= pairs["at"] + self.deadline) & (pairs["fresh"] | pairs["fresh_made"])
        pairs = pairs[within]
        if len(pairs):
            told = t["told"].to_numpy().copy()
            told[pairs["place"].to_numpy()] = told[pairs["place_made"].to_numpy()] = True
            t["told"] = told
            yield pd.DataFrame({"key": pairs["key"], "asked_at": pairs["at"], "made_at": pairs["at_made"]})
        self._keep(t)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.held.get()
        if state is None:
            return
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        t = _unfolded(state[0])
        at, asked = t["at"].to_numpy(), t["side"].to_numpy() == ASKED
        if self._due(t).min() >= passed:
            return  # what this timer was for came with an earlier one
        ends = np.where(asked, at + self.deadline, at) < passed
        alone = t[ends & ~t["told"].to_numpy()]
        if len(alone):
            is_asked = alone["side"] == ASKED
            yield pd.DataFrame({"key": alone["key"], "asked_at": alone["at"].where(is_asked, _NONE), "made_at": alone["at"].where(~is_asked, _NONE)})
        self._keep(t.assign(told=t["told"] | ends, over=ends, known=t["known"] & (at + self.late >= passed)))

    def close(self) -> None:
        pass


def _micros(spark, interval: str) -> int:
    return spark.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {interval}"))).first()[0]


def census_gate(dispatched: DataFrame, produced: DataFrame, deadline: str = "1 hour", late: str = "2 hours", key: str = "id") -> DataFrame:
    """(id, class, asked_at, made_at): matched, missing (no reply by the deadline), extra (no dispatch up to the deadline before it).

    Both are streams (key, ts), joined by key and time; pairs are given as they meet, and state is
    dropped once the watermarks of both are past the deadline.  Repeats of a key within the lateness
    count once: of those in one batch the first in time.
    """
    spark = dispatched.sparkSession
    kind = dispatched.schema[key].dataType

    def timed(rows: DataFrame, side: int) -> DataFrame:
        found = rows.select(F.lit(side).alias("side"), F.col(key).cast(kind).alias("key"), F.col("ts").cast("timestamp").alias("ts"))
        return found.where(F.col("key").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)

    both = timed(dispatched, ASKED).union(timed(produced, MADE))
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("_bucket")
    out = StructType([StructField("key", kind), StructField("asked_at", LongType()), StructField("made_at", LongType())])
    gate = _Gate(_micros(spark, deadline), _micros(spark, late))
    told = both.select(bucket, "side", "key", F.unix_micros("ts").alias("at"), "ts").groupBy("_bucket").transformWithStateInPandas(gate, out, "append", "eventTime")
    at = lambda c: F.when(F.col(c) > F.lit(_NONE), F.timestamp_micros(c)).alias(c)
    what = F.when(F.col("asked_at") == F.lit(_NONE), "extra").when(F.col("made_at") == F.lit(_NONE), "missing").otherwise("matched")
    return told.select(F.col("key").alias(key), what.alias("class"), at("asked_at"), at("made_at"))
