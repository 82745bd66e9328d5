"""Streams as batch documents with a tip: appends that overflow a tip into a batch of their own, unfolds beside events, and
the access strategies that rest on them.

A tip holds the last events of a stream (from `i` to `n`), its unfolds at version `n`, an etag of its last write, how many
events that write has appended (`a`) and how many characters of events lie in the batches before it (`b`).
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import Event, WrongExpectedVersion
from .decider import Cache, Decider, Loaded, LoadOption

MAX_EVENT_BYTES, MAX_BYTES = 32 * 1024, 32 * 1024
EVENT = "struct<position:bigint,type:string,data:string>"
UNFOLD = "struct<type:string,data:string>"


def size_of(events: Column) -> Column:
    return F.aggregate(events, F.lit(0).cast("long"), lambda t, e: t + F.length(e["type"]) + F.coalesce(F.length(e["data"]), F.lit(0)))


def appended(tips: DataFrame, requests: DataFrame, max_events: int | None = None, max_event_bytes: int = MAX_EVENT_BYTES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(stream_name, outcome, kind, i, n, a, b, e, c, u): the documents that appends to many streams write, a row each.

    tips: (stream_name, n, etag, e, u, b), requests: (stream_name, expected_version, expected_etag, events, unfolds), at most
    one a stream, of EVENT and UNFOLD arrays (positions of new events are given here). An expected etag decides where there
    is one, else the version; a request that is not met has the outcome ConflictUnknown and no document. The tip's events
    go to a batch, and the new ones alone stay, where all together would be more than a bound and the tip has any."""
    held = tips.select("stream_name", F.col("n").alias("__n"), F.col("etag").alias("__etag"), F.col("e").alias("__e"), F.col("b").alias("__b"))
    both = requests.join(held, "stream_name", "left")
    version = F.coalesce("__n", F.lit(0)).cast("long")
    cur = F.coalesce("__e", F.array().cast(f"array<{EVENT}>"))
    new = F.transform("events", lambda e, k: F.struct((version + k).alias("position"), e["type"].alias("type"), e["data"].alias("data")))
    met = F.when(F.col("expected_etag").isNotNull(), F.col("expected_etag").eqNullSafe(F.col("__etag"))).otherwise(F.col("expected_version").eqNullSafe(version))
    both = both.select("stream_name", met.alias("met"), version.alias("version"), cur.alias("cur"), new.alias("new"), F.coalesce("unfolds", F.array().cast(f"array<{UNFOLD}>")).alias("u"), F.coalesce("__b", F.lit(0)).cast("long").alias("b"))
    bytes_ = size_of(F.col("cur")) + size_of(F.col("new"))
    over = (bytes_ > max_event_bytes) | (bytes_ + size_of(F.col("u")) > max_bytes)
    over = over if max_events is None else over | (F.size("cur") + F.size("new") > max_events)
    both = both.withColumn("calve", over & (F.size("cur") > 0))

    def document(kind: str, first: Column, n: Column, a: Column, b: Column, e: Column, u: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), first.cast("long").alias("i"), n.cast("long").alias("n"), a.cast("long").alias("a"), b.cast("long").alias("b"), e.alias("e"), u.alias("u"))

    none = F.lit(None).cast("long")
    start, after = F.col("version") - F.size("cur"), F.col("version") + F.size("new")
    calf = document("batch", start, F.col("version"), none, none, F.col("cur"), F.array().cast(f"array<{UNFOLD}>"))
    tip = document("tip", F.when(F.col("calve"), F.col("version")).otherwise(start), after, F.size("new"), F.col("b") + F.when(F.col("calve"), size_of(F.col("cur"))).otherwise(0), F.when(F.col("calve"), F.col("new")).otherwise(F.concat("cur", "new")), F.col("u"))
    written = both.where("met").select("stream_name", F.lit("Written").alias("outcome"), F.explode(F.when(F.col("calve"), F.array(calf, tip)).otherwise(F.array(tip))).alias("d"))
    written = written.select("stream_name", "outcome", "d.kind", "d.i", "d.n", "d.a", "d.b", "d.e", F.col("d.e.type").alias("c"), "d.u")
    lost = both.where("not met").select("stream_name", F.lit("ConflictUnknown").alias("outcome"))
    return written.unionByName(lost, allowMissingColumns=True)


@dataclass
class Tip:
    n: int = 0
    etag: str | None = None
    events: list[Event] = field(default_factory=list)
    unfolds: list[Event] = field(default_factory=list)
    appended: int = 0
    before: int = 0


def weight(events: list[Event]) -> int:
    return sum(len(e.type) + len(e.data or "") for e in events)


@dataclass
class DocumentStore:
    """Single streams of documents, in the driver; appended() is the same rule for many at once."""

    max_events: int | None = None
    max_event_bytes: int = MAX_EVENT_BYTES
    max_bytes: int = MAX_BYTES
    tips: dict[str, Tip] = field(default_factory=dict)
    batches: dict[str, list[tuple[int, list[Event]]]] = field(default_factory=dict)
    lock: Any = field(default_factory=threading.Lock)

    def tip(self, stream: str) -> Tip:
        return self.tips.get(stream, Tip())

    def before_tip(self, stream: str):
        """Events that lie in batches, the last first, a batch at a time as they are asked for."""
        for first, events in reversed(self.batches.get(stream, [])):
            yield first, events

    def sync(self, stream: str, expected: int | str | None, events: list[Event], unfolds: list[Event]) -> Tip:
        """The tip after events and unfolds; expected is a version, an etag or None for a stream that isn't there."""
        if not events and not unfolds:
            raise ValueError("neither events nor unfolds to write")
        with self.lock:
            tip = self.tip(stream)
            if (tip.etag if isinstance(expected, str) else tip.n if tip.etag else 0) != (expected or 0):
                raise WrongExpectedVersion(stream, expected if isinstance(expected, int) else -1, tip.n)
            own = weight(tip.events) + weight(events)
            over = own > self.max_event_bytes or own + weight(unfolds) > self.max_bytes or (self.max_events is not None and len(tip.events) + len(events) > self.max_events)
            calve = over and bool(tip.events)
            if calve:
                self.batches.setdefault(stream, []).append((tip.n - len(tip.events), tip.events))
            held = events if calve else tip.events + events
            after = Tip(tip.n + len(events), uuid.uuid4().hex, list(held), list(unfolds), len(events), tip.before + (weight(tip.events) if calve else 0))
            self.tips[stream] = after
            return after


@dataclass(frozen=True)
class Access:
    """How a category reads and writes. is_origin: from which event or unfold a state can be made; unfolds: whether unfolds
    are looked at; transmute(events, state) gives the events and unfolds to write. by_etag: appends are checked by etag, as
    a write may leave the version where it is."""

    is_origin: Callable[[Any], bool] = lambda e: False
    unfolds: bool = False
    transmute: Callable[[list, Any], tuple[list, list]] = lambda events, state: (events, [])
    by_etag: bool = False


UNOPTIMIZED = Access()
LATEST_KNOWN_EVENT = Access(lambda e: True, True, lambda events, state: (events, events[-1:]))


def snapshot(is_origin: Callable, to_snapshot: Callable) -> Access:
    return Access(is_origin, True, lambda events, state: (events, [to_snapshot(state)]))


def multi_snapshot(is_origin: Callable, to_snapshots: Callable) -> Access:
    """Several unfolds make the state together."""
    return Access(is_origin, True, lambda events, state: (events, list(to_snapshots(state))))


def rolling_state(to_snapshot: Callable) -> Access:
    """The state alone is kept: no event is written, and the version stays."""
    return Access(lambda e: True, True, lambda events, state: ([], [to_snapshot(state)]), True)


def custom(is_origin: Callable, transmute: Callable) -> Access:
    return Access(is_origin, True, transmute, True)


@dataclass
class DocumentCategory:
    """Streams of one category in a DocumentStore, for Decider; codecs as those of decider.Category."""

    store: DocumentStore
    name: str
    fold: Callable[[Any, list], Any]
    initial: Any
    access: Access = UNOPTIMIZED
    decode: Callable[[Event], Any] = lambda e: e
    encode: Callable[[Any], Event] = lambda e: e
    cache: Cache | None = None
    etags: dict[str, str | None] = field(default_factory=dict)

    def load(self, stream: str, since: Loaded | None = None) -> Loaded:
        """From the last origin on: unfolds first, then the tip's events and the batches before it, a batch at a time until
        there is an origin. A tip that has not changed since is not read again."""
        tip = self.store.tip(stream)
        if since is not None and tip.etag is not None and self.etags.get(stream) == tip.etag:
            return since
        self.etags[stream] = tip.etag
        known = lambda events: [x for e in events if (x := self.decode(e)) is not None]
        unfolds = known(tip.unfolds) if self.access.unfolds else []
        if any(map(self.access.is_origin, unfolds)):
            return Loaded(tip.n, self.fold(self.initial, unfolds), weight(tip.unfolds))
        parts, bytes_ = [], 0
        for events in (tip.events, *(e for _, e in self.store.before_tip(stream))):
            own, bytes_ = known(events), bytes_ + weight(events)
            at = next((k for k in range(len(own) - 1, -1, -1) if self.access.is_origin(own[k])), None)
            parts.append(own if at is None else own[at:])
            if at is not None:
                break
        events = [e for part in reversed(parts) for e in part]
        return Loaded(tip.n, self.fold(self.initial, events) if events else self.initial, bytes_)

    def fetch(self, stream: str, option: LoadOption) -> Loaded:
        if option.assume_empty:
            return Loaded(0, self.initial)
        if self.cache is None:
            return self.load(stream)
        return self.cache.read_through((self.name, stream), option.max_stale, lambda known: self.load(stream, known))

    def sync(self, stream: str, loaded: Loaded, events: list) -> Loaded:
        state = self.fold(loaded.state, events)
        written, unfolds = self.access.transmute(events, state)
        expected = self.etags.get(stream) if self.access.by_etag else loaded.version
        tip = self.store.sync(stream, expected, [self.encode(e) for e in written], [self.encode(u) for u in unfolds])
        self.etags[stream] = tip.etag
        after = Loaded(tip.n, state)
        if self.cache is not None:
            self.cache.put((self.name, stream), after)
        return after

    def decider(self, stream_id: str, attempts: int = 3) -> Decider:
        return Decider(self, f"{self.name}-{stream_id}", attempts)
