"""Spans: runs of events of one stream, as arrays in a batch or as intervals of a log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Span:
    """Events of a stream from index `start` on."""

    start: int
    events: tuple

    @property
    def next(self) -> int:
        return self.start + len(self.events)


def drop_before(low: int, span: Span) -> Span:
    """The part of a span from index `low` on; empty if it ends before."""
    if not span.events or span.start >= low:
        return span
    return Span(low, span.events[low - span.start :]) if span.next > low else Span(low, ())


def merge(low: int, spans: list[Span]) -> list[Span]:
    """Spans from `low` on without overlaps, in order; spans that touch become one, gaps part them."""
    out: list[Span] = []
    for s in sorted((t for x in spans if (t := drop_before(low, x)).events), key=lambda t: t.start):
        if out and s.start <= out[-1].next:
            tail = drop_before(out[-1].next, s)
            out[-1] = Span(out[-1].start, out[-1].events + tail.events)
        else:
            out.append(s)
    return out


def islands(log: DataFrame, low: int = 0) -> DataFrame:
    """(stream_name, start, length): the merged spans of a log with repeats and gaps, from index `low` on.

    Repeats go by a partial aggregate; positions less their row number are one number within each run."""
    once = log.where(F.col("position") >= low).select("stream_name", "position").distinct()
    w = Window.partitionBy("stream_name").orderBy("position")
    marked = once.withColumn("run", F.col("position") - F.row_number().over(w))
    runs = marked.groupBy("stream_name", "run").agg(F.min("position").alias("start"), F.count("*").alias("length"))
    return runs.drop("run")


def gaps(log: DataFrame) -> DataFrame:
    """(stream_name, first_missing, missing): holes between a stream's events."""
    w = Window.partitionBy("stream_name").orderBy("position")
    once = log.select("stream_name", "position").distinct()
    before = F.lag("position", 1, -1).over(w)
    found = once.withColumn("first_missing", before + 1).where(F.col("position") > F.col("first_missing"))
    return found.select("stream_name", "first_missing", (F.col("position") - F.col("first_missing")).alias("missing"))


def has_gap(head: int | None, write: int) -> bool:
    """Whether the first buffered index is not the write position; unknown (-2) never has a gap."""
    return head is not None and write >= 0 and head != write


def flatten(spans: DataFrame) -> DataFrame:
    """(stream_name, start, events): spans (stream_name, i, c) of a batch as one span a stream, in order of start, with
    overlaps dropped. A gap raises."""
    ordered = F.array_sort(F.collect_list(F.struct("i", "c")))
    zero = F.struct(F.element_at("s", 1)["i"].alias("start"), F.array().cast("array<string>").alias("events"))

    def step(a, s):
        next_ = a["start"] + F.size(a["events"])
        overlap = (next_ - s["i"]).cast("int")
        more = F.slice(s["c"], F.least(overlap, F.size(s["c"])) + 1, F.greatest(F.size(s["c"]) - overlap, F.lit(0)))
        fresh = F.when(overlap < 0, F.raise_error(F.lit("gap within a batch of spans"))).otherwise(more)
        return F.struct(a["start"].alias("start"), F.concat(a["events"], fresh).alias("events"))

    grouped = spans.groupBy("stream_name").agg(ordered.alias("s"))
    return grouped.select("stream_name", F.aggregate("s", zero, step).alias("x")).select("stream_name", "x.*")


def required(log: DataFrame, *batch: str) -> DataFrame:
    """(batch columns, stream_name, required_index): the index a stream must reach before a batch of events is done."""
    return log.groupBy(*batch, "stream_name").agg((F.max("position") + 1).alias("required_index"))


def still_required(log: DataFrame, progress: DataFrame, *batch: str) -> DataFrame:
    """Requirements that streams have not met yet; progress: (stream_name, next_index)."""
    met = required(log, *batch).join(progress, "stream_name", "left").where("required_index > coalesce(next_index, 0)")
    return met.select(*batch, "stream_name", "required_index")


def gap_before(head: str, write: str) -> Column:
    """has_gap() as a column."""
    return F.coalesce((F.col(write) >= 0) & (F.col(head) != F.col(write)), F.lit(False))


def high_water(spans: DataFrame) -> DataFrame:
    """(stream_name, next_index): where the last span of each stream ends, by ordinal."""
    return spans.groupBy("stream_name").agg(F.max_by(F.col("i") + F.size("c"), "ordinal").cast("long").alias("next_index"))


def hydrate(spans: DataFrame, log: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Events of spans (stream_name, i, c) with their bodies: one row an index, joined on (stream_name, position). wanted
    chooses by stream_name and c whose bodies are read at all; others are left out before the join."""
    spans = spans if wanted is None else spans.where(wanted)
    each = spans.select("stream_name", F.posexplode("c").alias("__k", "__t"), "i").select("stream_name", (F.col("i") + F.col("__k")).alias("position"))
    return each.distinct().join(log, ["stream_name", "position"])


def index_only(spans: DataFrame) -> DataFrame:
    """Events of spans with types and no bodies."""
    each = spans.select("stream_name", "i", F.posexplode("c").alias("k", "type"))
    return each.select("stream_name", (F.col("i") + F.col("k")).alias("position"), "type", F.lit(None).cast("string").alias("data"))


def spans_of(log: DataFrame, length: int) -> DataFrame:
    """(stream_name, ordinal, i, c): a log cut in spans of up to `length` events, ordinals by first global position."""
    cut = log.withColumn("b", F.expr(f"position div {length}"))
    return cut.groupBy("stream_name", "b").agg(
        F.min("global_position").alias("ordinal"), F.min("position").alias("i"), F.array_sort(F.collect_list(F.struct("position", "type")))["type"].alias("c")
    ).drop("b")


def parse_changes(records: DataFrame) -> DataFrame:
    """(stream_name, i, c) from change records (op, stream_name, n, a, c): the last `a` types of c. Removals and system
    streams ($...) are passed by; an unknown op raises."""
    known = F.when(F.col("op").isin("INSERT", "MODIFY"), True).when(F.col("op") == "REMOVE", False).otherwise(
        F.raise_error(F.concat(F.lit("unknown change: "), F.col("op")))
    )
    found = records.where(known & ~F.col("stream_name").startswith("$") & (F.col("a") > 0))
    fresh = F.slice("c", F.size("c") - F.col("a").cast("int") + 1, F.col("a").cast("int"))
    return found.select("stream_name", (F.col("n") - F.col("a")).alias("i"), fresh.alias("c"))
