"""A columnar log with optimistic appends, and keyed tables, as Parquet files behind a manifest.

An append reads the versions it depends on, writes its files beside the log and then publishes them with a manifest of
the next number, which one writer can put in place. Readers see a manifest's files or the next one's, never a part.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators.folds import with_positions
from .logs import SCHEMA


class WrongExpectedVersion(RuntimeError):
    def __init__(self, stream: str, expected: int, found: int):
        super().__init__(f"Wrong expected version: {expected} (Stream: {stream}, Stream Version: {found})")
        self.stream, self.expected, self.found = stream, expected, found


class ConcurrentWrite(RuntimeError):
    """Another writer has come first; what was read is no longer the last."""


@dataclass
class Event:
    type: str
    data: str | None = None
    metadata: str | None = None
    id: str | None = None


@dataclass
class MemoryStore:
    """A volatile log in the driver: streams as lists of events; replays deliver whole streams."""

    streams: dict[str, list[Event]] = field(default_factory=dict)
    writes: list[tuple[str, tuple[Event, ...]]] = field(default_factory=list)

    def version(self, stream: str) -> int:
        return len(self.streams.get(stream, ()))

    def load(self, stream: str, since: int = 0) -> list[Event]:
        return self.streams.get(stream, [])[since:]

    def append(self, stream: str, expected: int | None, events: list[Event]) -> int:
        found = self.version(stream)
        if expected is not None and expected != found:
            raise WrongExpectedVersion(stream, expected, found)
        whole = self.streams.setdefault(stream, [])
        whole += events
        self.writes.append((stream, tuple(whole)))
        return len(whole)

    def handle_from(self, ordinal: int, deliver) -> int:
        for stream, whole in self.writes[ordinal:]:
            deliver(stream, list(whole))
        return len(self.writes)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s, k, e.type, e.data, e.metadata, e.id) for s, es in self.streams.items() for k, e in enumerate(es)]
        return spark.createDataFrame(rows, "stream_name string, position long, type string, data string, metadata string, id string")


class LogStore:
    """A log in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _last(self) -> int:
        """Number of the newest manifest, 0 for none."""
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return max((int(n[9:19]) for n in names if n.startswith("manifest-") and len(n) == 24), default=0)

    def _manifest(self) -> dict:
        last = self._last()
        if not last:
            return {"number": 0, "files": [], "next": 1, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifest-{last:010d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        """Puts the next manifest in place under its number; another writer's of that number makes this one fail."""
        manifest["number"] += 1
        staged = self._path(f"{self.path}/staged-{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        at = self._path(f"{self.path}/manifest-{manifest['number']:010d}.json")
        if self._fs.exists(at) or not self._fs.rename(staged, at):
            self._fs.delete(staged, False)
            raise ConcurrentWrite(f"manifest {manifest['number']} is another writer's")

    def _drop(self, at: str) -> None:
        """Files that no manifest names."""
        self._fs.delete(self._path(at), True)

    def log(self) -> DataFrame:
        return self._log_of(self._manifest())

    def _log_of(self, manifest: dict) -> DataFrame:
        files = manifest["files"]
        return self.spark.read.schema(SCHEMA).parquet(*files) if files else self.spark.createDataFrame([], SCHEMA)

    def version(self, stream: str) -> int:
        found = self.log().where(F.col("stream_name") == stream).agg(F.max("position")).first()[0]
        return 0 if found is None else found + 1

    def load(self, stream: str, since: int = 0) -> list[Event]:
        """A stream's events from a position on, in order. Files are sorted by stream and position, so that statistics let
        readers pass by other streams."""
        found = self.log().where((F.col("stream_name") == stream) & (F.col("position") >= since))
        rows = found.select("position", "type", "data", "metadata", "id").collect()
        return [Event(r.type, r.data, r.metadata, r.id) for r in sorted(rows, key=lambda r: r.position)]

    def append(self, stream: str, expected: int | None, events: list[Event]) -> int:
        """All events or none; the stream's version after them. expected None doesn't check."""
        rows = [(stream, k, e.type, e.data, e.metadata, e.id) for k, e in enumerate(events)]
        frame = self.spark.createDataFrame(rows, "stream_name string, n long, type string, data string, metadata string, id string")
        if not events:
            found = self.version(stream)
            if expected not in (None, found):
                raise WrongExpectedVersion(stream, expected, found)
            return found
        return self.append_frame(frame, {stream: expected})[stream]

    def append_frame(self, events: DataFrame, expected: dict[str, int | None] | None = None, attempts: int = 10, project=None) -> dict[str, int]:
        """Appends (stream_name, n, type, data, metadata, id) in order of n, all or nothing; versions of the streams that
        were checked. Versions of other streams are not collected. Where another writer comes first, versions are read
        and checked again: writers of other streams don't fail each other.

        project(rows, read) gives tables by name that are to change with the append, made of the appended rows and of
        read(name), the table that was there (None without one): the log and they are published together or not at all."""
        for attempt in range(1, attempts + 1):
            try:
                return self._append_once(events, expected, project)
            except ConcurrentWrite:
                if attempt == attempts:
                    raise
        raise AssertionError

    def _append_once(self, events: DataFrame, expected: dict[str, int | None] | None, project) -> dict[str, int]:
        manifest = self._manifest()
        log = self._log_of(manifest)
        touched = events.select("stream_name").distinct()
        versions = log.join(touched, "stream_name", "left_semi").groupBy("stream_name").agg((F.max("position") + 1).alias("version"))
        wanted = list(expected or {})
        # the filter reaches the scan of the log, which reads the groups of rows that have these streams
        found = log.where(F.col("stream_name").isin(wanted)).groupBy("stream_name").agg((F.max("position") + 1).alias("version")) if wanted else None
        found = {r.stream_name: r.version for r in found.collect()} if wanted else {}
        for stream, version in (expected or {}).items():
            if version not in (None, found.get(stream, 0)):
                raise WrongExpectedVersion(stream, version, found.get(stream, 0))
        placed = with_positions(events, versions, "n")
        numbered = placed.withColumn("global_position", F.monotonically_increasing_id() + F.lit(manifest["next"]))
        rows = numbered.select(
            "global_position", "stream_name", N.category("stream_name").alias("category"), "position", "type", "data", "metadata",
            F.expr("cast(current_timestamp() as timestamp_ntz)").alias("time"), F.coalesce("id", F.expr("uuid()")).alias("id"), F.lit(False).alias("is_unfold"),
        )
        at = f"{self.path}/part-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA]).sortWithinPartitions("stream_name", "position").write.parquet(at)
        top = self.spark.read.parquet(at).agg(F.max("global_position")).first()[0]
        manifest["files"].append(at)
        manifest["next"] = manifest["next"] if top is None else top + 1
        made = [at]
        try:
            old = lambda name: self.spark.read.parquet(manifest["tables"][name]) if name in manifest["tables"] else None
            for name, table in (project(self.spark.read.schema(SCHEMA).parquet(at), old) if project else {}).items():
                made.append(f"{self.path}/table-{name}-{uuid.uuid4().hex}")
                table.write.parquet(made[-1])
                manifest["tables"] = manifest["tables"] | {name: made[-1]}
            self._publish(manifest)
        except BaseException:
            for x in made:
                self._drop(x)
            raise
        if not wanted:
            return {}
        after = self.spark.read.parquet(at).where(F.col("stream_name").isin(wanted)).groupBy("stream_name").agg(F.max("position") + 1)
        return {r[0]: r[1] for r in after.collect()}

    def at(self, name: str) -> str | None:
        """Where the last version of a table lies; None where there is none."""
        return self._manifest()["tables"].get(name)

    def read(self, name: str) -> DataFrame:
        at = self.at(name)
        if at is None:
            raise KeyError(name)
        return self.spark.read.parquet(at)

    #: That a table is replaced whichever version is the last.
    ANY = object()

    def replace(self, name: str, rows: DataFrame, expected=ANY) -> None:
        """A keyed table as a whole; readers of the old one keep its files. expected is where the version lies that rows were
        made of (at()); if another one has come since, this one fails with ConcurrentWrite."""
        at = f"{self.path}/table-{name}-{uuid.uuid4().hex}"
        rows.write.parquet(at)
        while True:
            manifest = self._manifest()
            if expected is not LogStore.ANY and manifest["tables"].get(name) != expected:
                self._drop(at)
                raise ConcurrentWrite(f"table {name} has another version")
            manifest["tables"][name] = at
            try:
                return self._publish(manifest)
            except ConcurrentWrite:
                continue  # of the log or another table, or else the check above fails


def retried(once, attempts: int = 10):
    """once(), again while other writers come first."""
    for attempt in range(1, attempts + 1):
        try:
            return once()
        except ConcurrentWrite:
            if attempt == attempts:
                raise


class Checkpoints:
    """Positions of (group, category) in a store's table. load() puts a start where there is none; save() overwrites."""

    def __init__(self, store: LogStore, name: str = "checkpoints"):
        self.store, self.name = store, name

    def _rows(self) -> tuple[dict[tuple[str, str], str], str | None]:
        at = self.store.at(self.name)
        rows = self.store.spark.read.parquet(at).collect() if at else []
        return {(r.group_name, r.category): r.position for r in rows}, at

    def _put(self, rows: dict, at: str | None) -> None:
        made = [(g, c, p) for (g, c), p in rows.items()]
        self.store.replace(self.name, self.store.spark.createDataFrame(made, "group_name string, category string, position string"), at)

    def load(self, group: str, category: str, origin: int | None = None) -> int:
        def once():
            rows, at = self._rows()
            if (group, category) not in rows:
                rows[group, category] = str(origin or 0)
                self._put(rows, at)
            return int(rows[group, category])

        return retried(once)

    def save(self, group: str, category: str, position: int) -> None:
        def once():
            rows, at = self._rows()
            if (group, category) in rows:
                rows[group, category] = str(position)
                self._put(rows, at)

        retried(once)
