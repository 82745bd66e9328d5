"""Snapshots and access strategies: each gives the state that a fold of the whole stream gives, from fewer events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from .scans import last_messages


def adjacent(log: DataFrame, states: DataFrame, frequency: int, type_: str = "Snapshotted") -> DataFrame:
    """Snapshot events to append: states (stream_name, version, data) of streams whose version is `frequency` or more
    beyond their last snapshot in the log. They go to the stream {category}:snapshot-{id}."""
    last = read_adjacent(log).select("stream_name", F.col("version").alias("__before"))
    due = states.join(last, "stream_name", "left").where(F.col("version") - F.coalesce("__before", F.lit(0)) >= frequency)
    return due.select(
        N.snapshot_stream("stream_name").alias("stream_name"),
        F.concat(N.category("stream_name"), F.lit(":snapshot")).alias("category"),
        F.lit(type_).alias("type"),
        "data",
        F.to_json(F.struct(F.col("version").cast("string").alias("version"))).alias("metadata"),
    )


def read_adjacent(log: DataFrame, type_: str | None = None) -> DataFrame:
    """(stream_name, version, data): the last snapshot of each stream, by its own stream's name."""
    snaps = log.where(F.col("category").endswith(":snapshot"))
    found = last_messages(snaps, type_, ("metadata", "data"))
    name = F.concat(F.regexp_replace(N.category("stream_name"), ":snapshot$", ""), F.lit("-"), N.stream_id("stream_name"))
    return found.select(name.alias("stream_name"), N.snapshot_version("metadata").alias("version"), "data")


def events_since(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Events beyond each stream's snapshot (version): all of a stream that has none."""
    known = snapshots.select("stream_name", F.col("version").alias("__version"))
    return log.join(known, "stream_name", "left").where(F.col("position") >= F.coalesce("__version", F.lit(0))).drop("__version")


def resumed(log: DataFrame, snapshots: DataFrame, start: Column, tail: Column, combine) -> DataFrame:
    """(stream_name, state): an algebraic fold that goes on from snapshots (stream_name, version, state). tail is the
    aggregate of later events, start the state of streams without a snapshot, combine(state, tail) joins them."""
    later = events_since(log, snapshots).groupBy("stream_name").agg(tail.alias("__tail"))
    both = later.join(snapshots.select("stream_name", F.col("state").alias("__state")), "stream_name", "full")
    state = F.coalesce("__state", start)
    return both.select("stream_name", F.when(F.col("__tail").isNull(), state).otherwise(combine(state, F.col("__tail"))).alias("state"))


def read_table(snapshots: DataFrame, full: DataFrame, usable: Column) -> DataFrame:
    """(stream_name, state, source): the snapshot table's state where it is usable, else the full fold's."""
    known = snapshots.where(usable).select("stream_name", F.col("state").alias("__state"))
    joined = full.join(known, "stream_name", "left")
    source = F.when(F.col("__state").isNull(), "fold").otherwise("snapshot")
    return joined.select("stream_name", F.coalesce("__state", "state").alias("state"), source.alias("source"))


def upserted(table: DataFrame, rows: DataFrame, key: str = "stream_name") -> DataFrame:
    """The table after rows replace those of their keys."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def swapped(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rolling state: rows with `applied`: a row replaces the stored one only if its expected etag
    is the stored one's, or both are missing. No event is written, and the version stays."""
    stored = table.select("stream_name", F.col("etag").alias("__etag"))
    judged = rows.join(stored, "stream_name", "left")
    return judged.withColumn("applied", F.col("__etag").eqNullSafe(F.col("expected_etag"))).drop("__etag")


def rolled(table: DataFrame, rows: DataFrame) -> DataFrame:
    """The table (stream_name, etag, ...) after rows (its columns and expected_etag) have been swapped in where they may be,
    under their own etags; a row of a stream that the table lacks goes in if it expects none. The version stays a row's own."""
    judged = swapped(table, rows).where("applied").select(*table.columns)
    return table.join(judged.select("stream_name"), "stream_name", "left_anti").select(*table.columns).unionByName(judged)


def unfolds(states: DataFrame, type_: str) -> DataFrame:
    """States as unfold rows, at the index they were taken at."""
    return states.select("stream_name", F.col("version").alias("position"), F.lit(type_).alias("type"), "data", F.lit(True).alias("is_unfold"))
