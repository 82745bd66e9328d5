"""The append index: spans of appended events, in epochs that close when they are full.

An epoch is a small ordered log that one writer extends, so its rules are plain Python over bounded state; reading
epochs, and taking a large batch into one in bulk, are DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N

MAX_STREAMS, MAX_VERSION, MAX_BYTES = 100_000, 5_000, 1 << 20
SELF = "$AppendsEpoch-"


@dataclass(frozen=True)
class StreamSpan:
    stream: str
    index: int
    types: tuple[str, ...]

    @property
    def next(self) -> int:
        return self.index + len(self.types)

    def since(self, index: int) -> StreamSpan:
        return StreamSpan(self.stream, index, self.types[index - self.index :])

    @property
    def bytes(self) -> int:
        return len(self.stream) + 20 + sum(len(t) + 3 for t in self.types)


class GapError(ValueError):
    pass


def flattened(spans: Iterable[StreamSpan]) -> list[StreamSpan]:
    """One span a stream, by start; overlaps go, a gap raises."""
    by: dict[str, StreamSpan] = {}
    for s in sorted(spans, key=lambda s: s.index):
        known = by.get(s.stream)
        if known is None:
            by[s.stream] = s
        elif s.index > known.next:
            raise GapError(f"{s.stream}: span at {s.index} where {known.next} was to follow")
        elif s.next > known.next:
            by[s.stream] = StreamSpan(s.stream, known.index, known.types + s.since(known.next).types)
    return list(by.values())


@dataclass
class Epoch:
    """One epoch: its changes, the next index of each stream seen in it, and whether it is closed."""

    changes: list[list[StreamSpan]] = field(default_factory=list)
    heads: dict[str, int] = field(default_factory=dict)
    closed: bool = False
    size: int = 0

    @property
    def version(self) -> int:
        return len(self.changes) + self.closed

    def fresh(self, span: StreamSpan) -> StreamSpan | None:
        """What of a span is new here; None if nothing is. A span that starts beyond the known end is a gap."""
        head = self.heads.get(span.stream)
        if head is None:
            return span
        if span.index > head:
            raise GapError(f"{span.stream}: span at {span.index} where {head} was to follow")
        return span.since(head) if span.next > head else None

    def residual(self, spans: Iterable[StreamSpan]) -> list[StreamSpan]:
        """What a closed epoch leaves for the next one: all that is new, gaps included."""
        out = []
        for s in flattened(spans):
            try:
                s = self.fresh(s)
            except GapError:
                pass
            out += [s] if s else []
        return out

    def ingest(self, spans: Iterable[StreamSpan], full: Callable[[Epoch, int], bool]) -> tuple[list[str], list[StreamSpan]]:
        """(streams that were accepted, residual spans). A gap in an open epoch raises and changes nothing."""
        spans = list(spans)
        if any(s.stream.startswith(SELF) for s in spans):
            raise ValueError("spans of the index itself are filtered before they come here")
        if self.closed:
            return [], self.residual(spans)
        new = [x for s in flattened(spans) if (x := self.fresh(s))]
        if not new:
            return [], []
        new.sort(key=lambda s: s.stream in self.heads)  # streams that start here, then those that go on
        closing = full(self, len(new) + len(self.heads))
        self.changes.append(new)
        self.size += sum(s.bytes for s in new)
        self.heads |= {s.stream: s.next for s in new}
        self.closed = closing
        return [s.stream for s in new], []


@dataclass
class Index:
    """A partition's epochs and the active one, which only moves forward."""

    max_streams: int = MAX_STREAMS
    max_version: int = MAX_VERSION
    max_bytes: int = MAX_BYTES
    epochs: dict[int, Epoch] = field(default_factory=dict)
    active: int = 0

    def full(self, epoch: Epoch, streams: int) -> bool:
        return epoch.size > self.max_bytes or epoch.version >= self.max_version or streams >= self.max_streams

    def mark(self, epoch: int) -> None:
        self.active = max(self.active, epoch)

    def ingest_many(self, items: Iterable[tuple[int, StreamSpan]]) -> list[str]:
        """Ingests spans, each aimed at an epoch, the lowest epoch first; what a closed epoch leaves goes to the next."""
        waiting: dict[int, list[StreamSpan]] = {}
        for at, span in items:
            waiting.setdefault(at, []).append(span)
        accepted: list[str] = []
        while waiting:
            at = min(waiting)
            epoch = self.epochs.setdefault(at, Epoch())
            got, rest = epoch.ingest(waiting.pop(at), self.full)
            accepted += got
            if rest:
                waiting[at + 1] = rest + waiting.get(at + 1, [])
            self.mark(at)
        return accepted

    def ingest(self, spans: Iterable[StreamSpan]) -> list[str]:
        return self.ingest_many([(self.active, s) for s in spans])

    def rows(self) -> list[tuple[int, int, str, int, list[str]]]:
        """(epoch, ordinal, stream, i, c) of every ingested span."""
        return [(e, k, s.stream, s.index, list(s.types)) for e, x in sorted(self.epochs.items()) for k, change in enumerate(x.changes) for s in change]


def read_epoch(changes: DataFrame, epoch: int, min_ordinal: int = 0) -> DataFrame:
    """(ordinal, spans) of one epoch's changes (epoch, ordinal, stream_name, i, c) from an ordinal on."""
    found = changes.where((F.col("epoch") == epoch) & (F.col("ordinal") >= min_ordinal))
    return found.groupBy("ordinal").agg(F.array_sort(F.collect_list(F.struct("stream_name", "i", "c"))).alias("spans"))


def heads(changes: DataFrame) -> DataFrame:
    """(partition, active_epoch) from changes with a partition."""
    return changes.groupBy("partition").agg(F.max("epoch").alias("active_epoch"))


def crawl(changes: DataFrame, epochs: DataFrame, cutoff: int) -> DataFrame:
    """(epoch, batch, spans, checkpoint, is_tail): each epoch's changes cut in batches of at most `cutoff` spans, or of
    one change that has more.

    epochs: (epoch, version, closed). A cut batch's checkpoint is the first change it leaves out; the last one's is
    where the next read starts. An epoch is a bounded log, so its window is too.
    """
    sizes = changes.groupBy("epoch", "ordinal").agg(F.count("*").alias("n"))
    changes_of = sizes.groupBy("epoch").agg(F.array_sort(F.collect_list(F.struct("ordinal", "n"))).alias("s"))
    kind = "array<struct<spans:bigint,upto:bigint>>"

    def step(done, s):
        grows = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["spans"] + s["n"] <= cutoff)
        added = F.struct((F.try_element_at(done, F.lit(-1))["spans"] + s["n"]).alias("spans"), (s["ordinal"] + 1).alias("upto"))
        new = F.struct(s["n"].alias("spans"), (s["ordinal"] + 1).alias("upto"))
        return F.when(grows, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(added))).otherwise(F.concat(done, F.array(new)))

    cut = changes_of.select("epoch", F.aggregate("s", F.array().cast(kind), step).alias("b"))
    each = cut.select("epoch", F.size("b").alias("n"), F.posexplode("b").alias("batch", "x")).join(epochs, "epoch")
    last = F.col("batch") == F.col("n") - 1
    there = F.when(last, N.after_epoch("epoch", "version", "closed")).otherwise(N.checkpoint("epoch", F.col("x.upto")))
    return each.select("epoch", F.col("batch").cast("long").alias("batch"), F.col("x.spans").alias("spans"), there.alias("checkpoint"), (last & ~F.col("closed")).alias("is_tail"))


def classify(spans: DataFrame, known: DataFrame) -> DataFrame:
    """spans (stream_name, i, c) with `outcome` against known (stream_name, next_index): start, append, discard or gap,
    and `fresh`, the events that are new."""
    joined = spans.join(known, "stream_name", "left")
    n = F.size("c")
    ends = F.col("i") + n
    outcome = (
        F.when(F.col("next_index").isNull(), "start")
        .when(F.col("i") > F.col("next_index"), "gap")
        .when(ends > F.col("next_index"), "append")
        .otherwise("discard")
    )
    skip = F.least(F.greatest(F.coalesce("next_index", "i") - F.col("i"), F.lit(0)), n).cast("int")
    return joined.select("stream_name", "i", outcome.alias("outcome"), F.slice("c", skip + 1, F.greatest(n - skip, F.lit(0))).alias("fresh"))


def assigned_epochs(spans: DataFrame, per_epoch: int) -> DataFrame:
    """spans with the epoch and ordinal that one writer gives them in order of `ordinal`, `per_epoch` changes each.

    Epochs are numbered over the whole log; counts of fixed ranges of ordinals are summed first, so no task holds more
    than a range."""
    ranged = spans.withColumn("__r", F.expr("ordinal div 65536"))
    per = ranged.groupBy("__r").agg(F.count("*").alias("__c"))
    before = per.withColumn("__b", F.sum("__c").over(Window.orderBy("__r")) - F.col("__c")).drop("__c")
    inner = F.row_number().over(Window.partitionBy("__r").orderBy("ordinal")) - 1
    placed = ranged.withColumn("__k", inner).join(before, "__r").withColumn("__n", F.col("__k") + F.col("__b"))
    return placed.withColumn("epoch", F.expr(f"__n div {per_epoch}")).withColumn("ordinal", F.expr(f"__n % {per_epoch}")).drop("__r", "__k", "__b", "__n")
