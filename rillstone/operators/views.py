"""Summaries and explorer queries. All aggregate before anything moves; a total is the sum of the groups' counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources.shared import written


def summary(log: DataFrame, *keys: str) -> DataFrame:
    """(keys, message_count, percent): counts and their share of all messages, to two places. The log is counted once; the
    total is the sum of the groups, one row that is broadcast."""
    groups = log.groupBy(*keys).agg(F.count("*").alias("message_count"))
    total = groups.agg(F.sum("message_count").alias("__total"))
    # one row, so the other side is never moved; both sides share the exchange of the groups
    return groups.crossJoin(F.broadcast(total)).select(
        *keys, "message_count", F.round(F.col("message_count") / F.col("__total") * 100, 2).alias("percent")
    )


def category_type_summary(log: DataFrame) -> DataFrame:
    return summary(log, "category", "type")


def stream_summary(log: DataFrame) -> DataFrame:
    return summary(log, "stream_name")


def stream_type_summary(log: DataFrame) -> DataFrame:
    return summary(log, "stream_name", "type")


def type_category_summary(log: DataFrame) -> DataFrame:
    return summary(log, "type", "category")


def type_stream_summary(log: DataFrame) -> DataFrame:
    return summary(log, "type", "stream_name")


def type_summary(log: DataFrame) -> DataFrame:
    return summary(log, "type")


def events_by_category(log: DataFrame) -> DataFrame:
    return log.groupBy("category").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "category")


def events_by_day(log: DataFrame, low, high, category: str | None = None) -> DataFrame:
    """(day, count) over times in [low, high]."""
    found = log.where(F.col("time").between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz")))
    found = found if category is None else found.where(F.col("category") == category)
    return found.groupBy(N.day_text("time").alias("day")).agg(F.count("*").alias("count")).orderBy("day")


def recent_streams(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest n events; a stream may come more than once."""
    return log.select("global_position", "stream_name", "type", "time").orderBy(F.desc("global_position")).limit(n)


def recent_distinct_streams(log: DataFrame, n: int = 20) -> DataFrame:
    last = log.groupBy("stream_name").agg(F.max("global_position").alias("global_position"))
    return last.orderBy(F.desc("global_position")).limit(n)


def causation_tree(edges: DataFrame) -> DataFrame:
    """(id, root, level) from edges (id, cause); a root is its own cause. An event whose chain of causes ends at one that is
    not at hand, or runs in a circle, has no root and is left out.

    Pointers double: each round joins every open event with the one its pointer has come to, so a chain of n events takes
    log2(n) rounds, whatever n; each round is a written table."""
    state = edges.groupBy("id").agg(F.min("cause").alias("up")).withColumn("level", F.when(F.col("id") == F.col("up"), 0).otherwise(1).cast("long"))
    state = written(state.withColumn("open", F.col("id") != F.col("up")), "causation")
    before = None
    while True:
        left = state.where("open").agg(F.count("*").alias("n"), F.sum("level").alias("steps")).first()
        # pointers that only run in circles double their steps without end; no chain has more steps than there are events
        if not left.n or (before is not None and left.n == before and left.steps > 2 * left.n * state.count()):
            break
        before = left.n
        to = state.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("level").alias("more"), F.col("open").alias("on"))
        moved = state.where("open").join(to, "up")  # a cause that is not at hand ends here
        moved = moved.select("id", F.col("further").alias("up"), (F.col("level") + F.col("more")).alias("level"), F.col("on").alias("open"))
        state = written(state.where("not open").unionByName(moved), "causation")
    return state.where("not open").select("id", F.col("up").alias("root"), "level")


def version_and_bytes(log: DataFrame) -> DataFrame:
    """(stream_name, version, bytes) of every stream."""
    return log.groupBy("stream_name").agg((F.max("position") + 1).alias("version"), F.sum(N.event_bytes()).alias("bytes"))


def append_types(log: DataFrame) -> DataFrame:
    """(stream_name, types): distinct types of each stream in order of first use."""
    first = log.groupBy("stream_name", "type").agg(F.min("position").alias("p"))
    return first.groupBy("stream_name").agg(F.array_join(F.array_sort(F.collect_list(F.struct("p", "type")))["type"], ",").alias("types"))


def feed_statistics(log: DataFrame, batch_size: int) -> DataFrame:
    """(category, events, pages, empty_pages, tail): what a feed that reads each category once has counted."""
    per = log.groupBy("category").agg(F.count("*").alias("events"), (F.max("global_position") + 1).alias("tail"))
    pages = F.ceil(F.col("events") / batch_size).cast("long")
    return per.select("category", "events", pages.alias("pages"), F.lit(1).cast("long").alias("empty_pages"), "tail")
