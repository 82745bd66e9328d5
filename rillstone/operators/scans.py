"""Scans of the log. Each is a filter on stored columns, so that it reaches the file scan; limits are top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N


def stream_messages(log: DataFrame, stream: str, position: int | None = 0, batch_size: int | None = 1000, condition: str | None = None, allow_condition: bool = False) -> DataFrame:
    """Events of one stream from `position` on, in order; batch_size -1 is without limit, null is the default."""
    if "-" not in stream:
        raise ValueError(f"must be a stream name: {stream}")
    found = log.where((F.col("stream_name") == stream) & (F.col("position") >= (position or 0)))
    return page(where(found, condition, allow_condition), "position", batch_size)


def category_messages(
    log: DataFrame, category: str, position: int | None = 1, batch_size: int | None = 1000, correlation: str | None = None,
    member: int | None = None, size: int | None = None, condition: str | None = None, allow_condition: bool = False,
) -> DataFrame:
    """Events of a category from a global position on, for one member of a consumer group, or of one correlation."""
    if "-" in category:
        raise ValueError(f"must be a category: {category}")
    found = log.where((F.col("category") == category) & (F.col("global_position") >= (1 if position is None else position)))
    if correlation is not None:
        if "-" in correlation:
            raise ValueError(f"must be a category: {correlation}")
        found = found.where(N.category(N.json_text("metadata", "correlationStreamName")) == correlation)
    if (member is None) != (size is None):
        raise ValueError("a consumer group needs member and size")
    if size is not None:
        if size < 1 or not 0 <= member < size:
            raise ValueError(f"member {member} is not in a group of {size}")
        found = found.where(N.group_member("stream_name", size) == member)
    return page(where(found, condition, allow_condition), "global_position", batch_size, sort_all=False)


def where(rows: DataFrame, condition: str | None, allowed: bool) -> DataFrame:
    if condition is None:
        return rows
    if not allowed:
        raise PermissionError("SQL conditions are not switched on")
    return rows.where(f"({condition})")


def page(rows: DataFrame, order: str, batch_size: int | None, sort_all: bool = True) -> DataFrame:
    """The first rows in order. Without a limit (-1) a whole category is not sorted: readers that need its order, which a
    distributed result has not, sort what they take."""
    size = 1000 if batch_size is None else batch_size
    if size == -1:
        return rows.orderBy(order) if sort_all else rows
    return rows.orderBy(order).limit(size)


def pages(log: DataFrame, stream: str, from_position: int, batch_size: int, max_batches: int | None = None) -> DataFrame:
    """A stream from a position on with the batch each event falls in. A reader stops at the first short batch; if that
    would be beyond max_batches, it raises."""
    found = stream_messages(log, stream, from_position, -1)
    order = Window.partitionBy("stream_name").orderBy("position")
    found = found.withColumn("__n", F.row_number().over(order) - 1)
    found = found.withColumn("batch", F.expr(f"__n div {batch_size}").cast("long")).drop("__n")
    if max_batches is not None:
        found = found.withColumn("batch", F.when(F.col("batch") >= max_batches, F.raise_error(F.lit("Batch limit exceeded"))).otherwise(F.col("batch")))
    return found


def batches_read(log: DataFrame, batch_size: int) -> DataFrame:
    """(stream_name, events, n_batches): reads a forward load of each stream takes, the last one short or empty."""
    return log.groupBy("stream_name").agg(F.count("*").alias("events")).withColumn("n_batches", F.expr(f"events div {batch_size} + 1"))


def last_message(log: DataFrame, stream: str, type_: str | None = None) -> DataFrame:
    found = log.where(F.col("stream_name") == stream)
    found = found if type_ is None else found.where(F.col("type") == type_)
    return found.orderBy(F.desc("position")).limit(1)


def last_messages(log: DataFrame, type_: str | None = None, columns=("global_position", "position", "type")) -> DataFrame:
    """The last event of every stream: one partial maximum a stream and task, no sort of streams."""
    log = log if type_ is None else log.where(F.col("type") == type_)
    return log.groupBy("stream_name").agg(F.max_by(F.struct(*columns), "position").alias("e")).select("stream_name", "e.*")


def category_batch(log: DataFrame, category: str, position: int, batch_size: int, **group) -> DataFrame:
    """One row: items, checkpoint and is_tail of the batch that a category reader gets at a position. A tail is an
    empty batch; the checkpoint is the last global position and one, or stays."""
    items = category_messages(log, category, position, batch_size, **group)
    return items.agg(
        F.count("*").alias("items"),
        F.coalesce(F.max("global_position") + 1, F.lit(position)).cast("long").alias("checkpoint"),
        (F.count("*") == 0).alias("is_tail"),
    )


def correlated(log: DataFrame, correlation_id: str, after: int = 0, limit: int | None = None) -> DataFrame:
    """Events of one correlation with a global position beyond `after`; index is the global position."""
    found = log.where((N.json_text("metadata", "$correlationId") == correlation_id) & (F.col("global_position") > after))
    found = found.orderBy("global_position").withColumn("index", F.col("global_position"))
    return found if limit is None else found.limit(limit)


def stream_versions(log: DataFrame) -> DataFrame:
    """(stream_name, last_position, version): version counts events."""
    return log.groupBy("stream_name").agg(F.max("position").alias("last_position")).withColumn("version", F.col("last_position") + 1)


def stream_version(log: DataFrame, stream: str) -> DataFrame:
    """One row: last_position (null when empty) and version (0 when empty)."""
    found = log.where(F.col("stream_name") == stream).agg(F.max("position").alias("last_position"))
    return found.withColumn("version", F.coalesce(F.col("last_position") + 1, F.lit(0)).cast("long"))


def from_origin(log: DataFrame, is_origin) -> DataFrame:
    """Events of every stream from its last origin on (all where there is none), in reading order; events stand before
    unfolds of the same index. origin is the position read from."""
    # the window runs over the column that readers filter on, so their filters go below it
    w = Window.partitionBy("stream_name")
    found = log.withColumn("origin", F.coalesce(F.max(F.when(is_origin, F.col("position"))).over(w), F.lit(0)).cast("long"))
    return found.where(F.col("position") >= F.col("origin"))


def range_read(log: DataFrame, stream: str, low: int, high: int, max_count: int | None = None, backwards: bool = False) -> DataFrame:
    """Events of a stream with positions in [low, high], at most max_count, from either end."""
    found = log.where((F.col("stream_name") == stream) & F.col("position").between(low, high))
    found = found.orderBy(F.desc("position") if backwards else F.asc("position"))
    return found if max_count is None else found.limit(max_count)


def walk(log: DataFrame, stream: str, backwards: bool = False, max_items: int = 100):
    """A stream as lists of at most max_items events, read as they are asked for, a partition at a time at the driver."""
    page_: list = []
    for row in range_read(log, stream, 0, 2**62, None, backwards).toLocalIterator():
        page_.append(row)
        if len(page_) == max_items:
            yield page_
            page_ = []
    if page_:
        yield page_


def as_batches(log: DataFrame, size: int) -> DataFrame:
    """Batch documents: (stream_name, b, i, n, etag, e, c, is_tip) with up to `size` events each, the last one the tip."""
    grouped = log.withColumn("b", F.expr(f"position div {size}")).groupBy("stream_name", "b").agg(
        F.min("position").alias("i"), (F.max("position") + 1).alias("n"), F.array_sort(F.collect_list(F.struct("position", "type", "data"))).alias("e")
    )
    tip = F.max("b").over(Window.partitionBy("stream_name")) == F.col("b")
    grouped = grouped.withColumn("c", F.col("e.type")).withColumn("is_tip", tip)
    return grouped.withColumn("etag", F.md5(F.concat_ws(":", "stream_name", F.col("n").cast("string"))))


def batch_range(batches: DataFrame, min_n: int, max_i: int | None = None, backwards: bool = False, limit: int | None = None, indexes_only: bool = False) -> DataFrame:
    """Batches that end beyond min_n and start before max_i, from either end; indexes_only gives i, c and n alone, so that
    bodies are not read."""
    found = batches.where(F.col("n") > min_n)
    found = found if max_i is None else found.where(F.col("i") < max_i)
    found = found.select("stream_name", "i", "c", "n") if indexes_only else found
    return found if limit is None else found.orderBy(F.desc("i") if backwards else F.asc("i"), "stream_name").limit(limit)


def tip_read(batches: DataFrame, known: DataFrame) -> DataFrame:
    """(stream_name, outcome, index, etag) for known (stream_name, etag): NotFound, NotModified or Found, the position to go
    on from and the tip's etag where it is Found."""
    tips = batches.where("is_tip").select("stream_name", F.col("etag").alias("__etag"), F.col("n").alias("__n"))
    joined = known.join(tips, "stream_name", "left")
    outcome = F.when(F.col("__etag").isNull(), "NotFound").when(F.col("__etag") == F.col("etag"), "NotModified").otherwise("Found")
    joined = joined.withColumn("outcome", outcome)
    found = lambda c: F.when(F.col("outcome") == "Found", F.col(c))
    return joined.select("stream_name", "outcome", found("__n").alias("index"), found("__etag").alias("etag"))


def unpacked(batches: DataFrame) -> DataFrame:
    """The events of batch documents as log rows."""
    return batches.select("stream_name", F.explode("e").alias("e")).select("stream_name", "e.*")


def stitched(archive: DataFrame, primary: DataFrame, tip: DataFrame | None = None) -> DataFrame:
    """Archive, primary and tip as one log; an event in several of them counts once."""
    every = archive.unionByName(primary)
    every = every if tip is None else every.unionByName(tip)
    return every.dropDuplicates(["stream_name", "position"])


def missing_origin(events: DataFrame) -> DataFrame:
    """Streams whose first event is not at hand: what a load without its archive raises for."""
    return events.groupBy("stream_name").agg(F.min("position").alias("first")).where("first > 0")


def loaded(tip: DataFrame, primary: DataFrame, archive: DataFrame | None = None, ignore_missing: bool = False) -> DataFrame:
    """Each stream from its origin: the tip, before it the primary store's events and before these the archive's. A stream
    whose first event none of them has raises, or is given from where it begins if ignore_missing."""
    every = stitched(primary, tip) if archive is None else stitched(archive, primary, tip)
    if ignore_missing:
        return every
    first = F.min("position").over(Window.partitionBy("stream_name"))
    lost = F.raise_error(F.concat(F.lit("origin event not found in "), F.col("stream_name")))
    return every.withColumn("__first", first).withColumn("position", F.when(F.col("__first") > 0, lost.cast("long")).otherwise(F.col("position"))).drop("__first")


def replay(writes: DataFrame, from_ordinal: int) -> DataFrame:
    """Deliveries of a volatile store: each write from an ordinal on delivers its whole stream up to that write.
    writes: (ordinal, stream_name, position, ...). What is delivered grows with the square of a stream's writes by
    definition; rows are made where they are used, one event at a time, and no stream is held together."""
    deliveries = writes.where(F.col("ordinal") >= from_ordinal).select(F.col("ordinal").alias("delivery"), "stream_name").distinct()
    return deliveries.join(writes, "stream_name").where("ordinal <= delivery")


def pruned(batches: DataFrame, gone: DataFrame) -> DataFrame:
    """Batches without those of gone (stream_name, i)."""
    return batches.join(gone.select("stream_name", "i"), ["stream_name", "i"], "left_anti")


def dumped(log: DataFrame, stream: str, text: bool = False) -> DataFrame:
    """A stream in order as JSON lines, or as plain text: position, type and data."""
    found = stream_messages(log, stream, 0, -1)
    line = F.concat_ws(" ", F.col("position").cast("string"), "type", "data") if text else F.to_json(F.struct("position", "type", "data"))
    return found.select(line.alias("line"))


def trace_attributes(batch: DataFrame, now=None) -> DataFrame:
    """(stream_name, category, first_index, last_index, events, lead_ms): what a span of the handler of each stream's events
    carries."""
    per = batch.groupBy("stream_name").agg(F.min("position").alias("first_index"), F.max("position").alias("last_index"))
    joined = per.join(lead_times(batch, now), "stream_name")
    return joined.select("stream_name", N.category("stream_name").alias("category"), "first_index", "last_index", "events", "lead_ms")


def lead_times(batch: DataFrame, now=None) -> DataFrame:
    """(stream_name, events, lead_ms) of a batch: how far each stream's last event lies before `now`, by default the last
    event of all."""
    per = batch.groupBy("stream_name").agg(F.count("*").alias("events"), F.max("time").alias("t"))
    top = per.agg(F.max("t").alias("__now")) if now is None else per.sparkSession.range(1).select(F.lit(now).cast("timestamp_ntz").alias("__now"))
    ms = F.unix_micros(F.col("__now").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp"))
    return per.crossJoin(F.broadcast(top)).select("stream_name", "events", F.floor(ms / 1000).alias("lead_ms"))
