"""Reactions: each stream's events reach a handler in order and, by their index, once.

A stream's state is its write position and the events that wait. The shuffle by stream_name makes streams independent
and each one serial; micro-batches come in order; the engine commits a batch when all its streams are done.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Write positions of streams of which nothing is known, and of those that can't be handled any more.
UNKNOWN, MALFORMED = -2, -3
RETRY_MS = 1_000

#: Results of a handler: nothing, all, the first n, or go on from an index.
NONE, ALL = ("none", 0), ("all", 0)


def take_all(stream: str, events: list) -> tuple[str, int]:
    """The plainest handler."""
    return ALL


def partial(n: int) -> tuple[str, int]:
    return "partial", n


def override(index: int) -> tuple[str, int]:
    return "override", index


def next_index(first: int, length: int, result: tuple[str, int] | None) -> int:
    kind, value = result or ALL
    return {"none": first, "all": first + length, "partial": first + value, "override": value}[kind]


@dataclass
class StreamState:
    """What is known of a stream: the write position and waiting events by index."""

    write: int
    waiting: dict[int, tuple]

    def add(self, index: int, event: tuple) -> None:
        if index >= self.write:
            self.waiting.setdefault(index, event)

    def head(self) -> list[tuple[int, tuple]]:
        """The first run of waiting events without a gap."""
        out: list[tuple[int, tuple]] = []
        for i in sorted(self.waiting):
            if out and i != out[-1][0] + 1:
                break
            out.append((i, self.waiting[i]))
        return out

    def move(self, index: int) -> None:
        if self.malformed:
            return
        self.write = max(index, 0)
        self.waiting = {i: e for i, e in self.waiting.items() if i >= self.write}

    @property
    def malformed(self) -> bool:
        return self.write == MALFORMED

    def combine(self, other: StreamState) -> None:
        """Takes over what another state of the stream knows: the further write position, and the events that wait in
        either. A malformed stream stays so."""
        self.write = MALFORMED if self.malformed or other.malformed else max(self.write, other.write)
        both = other.waiting | self.waiting
        self.waiting = {i: e for i, e in both.items() if i >= self.write}

    def react(self, stream: str, handler: Callable, require_complete: bool) -> Iterator[tuple[int, tuple]]:
        """Handles runs until none is ready or the handler makes no progress; yields what was handled. A malformed stream's
        events wait for good."""
        if self.malformed:
            return
        while run := self.head():
            first = run[0][0]
            if require_complete and self.write >= 0 and first != self.write:
                return
            result = handler(stream, run)
            after = next_index(first, len(run), result)
            yield from ((i, e) for i, e in run if i < after)
            self.move(after)
            if after <= first:
                return


class Reactor(StatefulProcessor):
    """handler(stream, [(index, (type, data))]) -> result. Events it leaves come again with the next ones, or after
    RETRY_MS where the query has processing time."""

    def __init__(self, handler: Callable, require_complete: bool = False, retry: bool = False):
        self.handler, self.require_complete, self.retry = handler, require_complete, retry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.write = handle.getValueState("write", StructType([StructField("write", LongType())]))
        event = StructType([StructField("position", LongType()), StructField("type", StringType()), StructField("data", StringType())])
        self.waiting = handle.getListState("waiting", event)

    def _run(self, stream: str, rows) -> Iterator[Row]:
        held = {r[0]: (r[1], r[2]) for r in self.waiting.get()} if self.waiting.exists() else {}
        state = StreamState(self.write.get()[0] if self.write.exists() else UNKNOWN, held)
        for r in rows:
            state.add(r.position, (r.type, r.data))
        for index, (type_, _) in state.react(stream, self.handler, self.require_complete):
            yield Row(stream_name=stream, position=index, type=type_)
        self.write.update((state.write,))
        self.waiting.clear()
        for i, e in sorted(state.waiting.items()):
            self.waiting.appendValue((i, *e))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._run(key[0], rows)
        if self.retry and self.waiting.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + RETRY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._run(key[0], ())
        if self.waiting.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + RETRY_MS)

    def close(self) -> None:
        pass


HANDLED = StructType([StructField("stream_name", StringType()), StructField("position", LongType()), StructField("type", StringType())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def react(events: DataFrame, handler: Callable, require_complete: bool = False, retry: bool = False) -> DataFrame:
    """(stream_name, position, type) of the events handled, from a streaming frame with stream_name, position, type and
    data. The session must use the RocksDB state store."""
    rows = events.select("stream_name", "position", "type", "data").groupBy("stream_name")
    return rows.transformWithState(
        statefulProcessor=Reactor(handler, require_complete, retry), outputStructType=HANDLED, outputMode="Update", timeMode="ProcessingTime" if retry else "None"
    )


def run_once(events: DataFrame, handler: Callable, checkpoint: str, sink: Callable, **how) -> None:
    """Handles all that is there and stops; sink(batch, id) gets what was handled, at least once a batch id."""
    spark = events.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        out = react(events, handler, **how).writeStream.outputMode("update").foreachBatch(sink)
        out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


class Dispatcher:
    """The same rules for batches in the driver: write positions by stream, batches completed in order of arrival."""

    def __init__(self, handler: Callable, require_complete: bool = False):
        self.handler, self.require_complete = handler, require_complete
        self.streams: dict[str, StreamState] = {}
        self.batches: list[tuple[dict[str, int], Callable]] = []

    def post(self, events: list[tuple[str, int, tuple]], done: Callable[[], None]) -> None:
        needs: dict[str, int] = {}
        for stream, index, event in events:
            state = self.streams.setdefault(stream, StreamState(UNKNOWN, {}))
            state.add(index, event)
            if state.write < index + 1:
                needs[stream] = max(needs.get(stream, 0), index + 1)
        self.batches.append((needs, done))

    def process(self) -> None:
        """Offers each stream's events, those of the oldest batch first, and completes batches whose streams are done."""
        order = dict.fromkeys(s for needs, _ in self.batches for s in needs)
        for stream in order:
            state = self.streams[stream]
            run = state.head()
            if not run or (self.require_complete and state.write >= 0 and run[0][0] != state.write):
                continue
            state.move(next_index(run[0][0], len(run), self.handler(stream, run)))
        while self.batches and all(self.streams[s].write >= n for s, n in self.batches[0][0].items()):
            self.batches.pop(0)[1]()
