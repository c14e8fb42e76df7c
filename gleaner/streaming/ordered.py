"""Ordered operators on streams, in the order of event time however the rows fall into batches.

Keys are dealt into ``BUCKETS`` by their hash, and a bucket is what the state store knows: a
call to the store costs far more than a step, and it is made for thousands of rows.  The rows of
a bucket wait in list state, a block for each batch, until the watermark passes them; an
event-time timer then hands them on, sorted by key, time and place, to a ``Machine`` for each
key: an operator that is one step for each row.  A machine may also end by itself at a time that it names (a poll that never hits, a
transcript that fell silent), and a timer sees to that where no row comes.  Ends and rows are
taken in the order of event time, so the result is that of the rows as a whole; only rows that
come behind the watermark of the batch before are left out, as everywhere on streams.  Nothing
later than that watermark has been handed on by then, so no row overtakes another.

State lives in the RocksDB store, which ``started`` sets for the query it starts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Machine:
    """One ordered operator: what it keeps of a key, and what it gives for the next row.

    ``fields`` and ``out`` are columns of rows and results as DDL, ``kept`` of what is kept.
    Times are microseconds of event time.
    """

    fields: str
    kept: str
    out: str

    def start(self) -> tuple:
        """What is kept before the first row."""
        raise NotImplementedError

    def step(self, kept: tuple, at: int, place: int, *row) -> tuple[tuple, list[tuple]]:
        """Take the row at ``at``; what is kept now, and results."""
        raise NotImplementedError

    def ends(self, kept: tuple) -> int | None:
        """When this key ends if nothing more comes; null if it doesn't."""
        return None

    def end(self, kept: tuple) -> tuple[tuple | None, list[tuple]]:
        """What is kept after the end (null: nothing), and results."""
        return None, []


def _timer(at: int) -> int:
    """The first millisecond at which the watermark has passed ``at``."""
    return -(-at // 1000)


#: Groups of keys in the state store; a checkpoint holds for one number only.
BUCKETS = 4096


class _InOrder(StatefulProcessor):
    def __init__(self, machine: Machine, names: list[str]) -> None:
        self.machine, self.names = machine, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "first long, rows string")  # JSON: [key, at, place, fields]
        self.kept = handle.getValueState("kept", "due long, keys string")  # JSON: {key: kept}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[2:]) for r in rows]  # behind bucket and ts
        first = min(r[1] for r in new)
        self.waiting.appendValue((first, json.dumps(new)))
        self.handle.registerTimer(_timer(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        blocks, state = list(self.waiting.get()), self.kept.get()
        if all(b[0] > passed for b in blocks) and (state is None or state[0] is None or state[0] > passed):
            return  # what this timer was for came with an earlier one
        machine = self.machine
        held = json.loads(state[1]) if state is not None else {}
        ready: dict[str, list] = {}
        later = []
        for b in blocks:
            for r in json.loads(b[1]):
                if r[1] <= passed:
                    ready.setdefault(r[0], []).append(r[1:])
                else:
                    later.append(r)
        out = Row(*self.names)
        due: int | None = None
        for name in {**held, **ready}:
            kept = tuple(held[name]) if name in held else None
            rows = sorted(ready.get(name, ()), key=lambda r: r[:2])
            for at, place, *row in [*rows, (None, None)]:
                before = passed if at is None else at - 1
                while kept is not None and (ends := machine.ends(kept)) is not None and ends <= before:
                    kept, found = machine.end(kept)
                    for x in found:
                        yield out(name, *x)
                if at is not None:
                    kept, found = machine.step(machine.start() if kept is None else kept, at, place, *row)
                    for x in found:
                        yield out(name, *x)
            if kept is None:
                held.pop(name, None)
                continue
            held[name] = kept
            ends = machine.ends(kept)
            if ends is not None and (due is None or ends < due):
                due = ends
        first = min((r[1] for r in later), default=None)
        if first is not None:
            self.waiting.put([(first, json.dumps(later))])
        elif blocks:
            self.waiting.clear()
        if held:
            self.kept.update((due, json.dumps(held)))
        elif state is not None:
            self.kept.clear()
        for at in {first, due} - {None}:
            self.handle.registerTimer(_timer(at))

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, place: str, machine: Machine, late: str) -> DataFrame:
    """The results of ``machine`` over ``events`` (key, ts, place and the machine's fields), by key.

    ``late``: how long after a row with a later time one may come.  Rows without a key or a time
    are left out, since they have no place in any order.
    """
    fields = StructType.fromDDL(machine.fields).fieldNames()
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int").alias("_bucket")
    at = F.unix_micros("ts").alias("at")
    rows = (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .where(F.col(key).isNotNull() & F.col("ts").isNotNull())
        .withWatermark("ts", late)
        .select(bucket, "ts", F.col(key).cast("string").alias(key), at, F.col(place).cast("long").alias("place"), *fields)
    )
    out = f"{key} string, {machine.out}"
    names = StructType.fromDDL(out).fieldNames()
    return rows.groupBy("_bucket").transformWithState(_InOrder(machine, names), out, "append", "eventTime")


def started(out: DataFrame, path: str, mode: str = "append", **trigger):
    """Start writing ``out`` to Parquet files below ``path``; what is there before is not given again."""
    spark = out.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:  # a query takes the settings of the session as they are when it starts
        writer = out.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before)
