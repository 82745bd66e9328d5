"""Feeds: a category of a log as a streaming source whose offset is the checkpoint, and the loop around a sink."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQueryListener

FEED = "stream_name string, category string, position bigint, global_position bigint, type string, data string, metadata string"
NAMES = [c.split()[0] for c in FEED.split(", ")]


@dataclass
class Range(InputPartition):
    """Global positions in [low, high) of some files."""

    low: int
    high: int
    files: tuple[str, ...]

    def __init__(self, low: int, high: int, files: tuple[str, ...]):
        self.low, self.high, self.files = low, high, files


def opened(path: str):
    """File system and path within it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return (fs.LocalFileSystem(), path.removeprefix("file:"))


def published(path: str) -> list[str]:
    """The Parquet files of a log: those of the newest manifest, so that a failed append's files are never read, or of the
    folder where there is none."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    system, root = opened(path)
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("manifest-") and len(f.base_name) == 24)
    if names:
        with system.open_input_stream(names[-1]) as f:
            folders = [opened(x)[1] for x in json.loads(f.read())["files"]]
    else:
        folders = [root]
    return [f for folder in folders for f in ds.dataset(folder, filesystem=system, format="parquet").files]


def spans(path: str) -> list[tuple[int, int, int, str]]:
    """(lowest, highest global position, rows, file) of each file of a log that has rows, from statistics alone."""
    import pyarrow.parquet as pq

    system, _ = opened(path)
    out = []
    for f in published(path):
        with system.open_input_file(f) as opened_file:
            meta = pq.ParquetFile(opened_file).metadata
            at = meta.schema.names.index("global_position")
            found = [s for g in range(meta.num_row_groups) if (s := meta.row_group(g).column(at).statistics) and s.has_min_max]
            if found:
                out.append((min(s.min for s in found), max(s.max for s in found), meta.num_rows, f))
    return sorted(out)


def rows(path: str, files: tuple[str, ...], category: str | None, low: int | None, high: int | None, columns: list[str] = NAMES):
    """Rows of some files of a log, in order of global position; filters go to the Parquet reader."""
    import pyarrow.dataset as ds

    data = ds.dataset(list(files), filesystem=opened(path)[0], format="parquet")
    want = None
    for part in (
        None if category is None else ds.field("category") == category,
        None if low is None else ds.field("global_position") >= low,
        None if high is None else ds.field("global_position") < high,
    ):
        if part is not None:
            want = part if want is None else want & part
    return data.to_table(columns=columns, filter=want).sort_by("global_position")


def top(path: str) -> int:
    """One beyond the last global position."""
    return max((high + 1 for _, high, _, _ in spans(path)), default=0)


def after(path: str, category: str | None, start: int, n: int) -> int:
    """Where a batch of n events of a category ends that begins at a global position: files are read in order, their
    positions alone, until there are n."""
    found: list[int] = []
    held = [x for x in spans(path) if x[1] >= start]
    for k, (_, _, _, f) in enumerate(held):
        found += rows(path, (f,), category, start, None, ["global_position"]).column(0).to_pylist()
        # what the next files have may lie between, as long as they begin before the nth
        if len(found) >= n and (k + 1 == len(held) or held[k + 1][0] > sorted(found)[n - 1]):
            return sorted(found)[n - 1] + 1
    return top(path) if held else start


def dealt(path: str, low: int, high: int, parts: int) -> list[Range]:
    """Files that have positions in [low, high), dealt to at most `parts` partitions by their rows."""
    groups: list[list] = [[0, []] for _ in range(parts)]
    for a, b, n, f in sorted(spans(path), key=lambda x: -x[2]):
        if b >= low and a < high:
            least = min(groups, key=lambda g: g[0])
            least[0] += n
            least[1].append(f)
    return [Range(low, high, tuple(g[1])) for g in groups if g[1]]


class CategoryStream(DataSourceStreamReader):
    """The offset is one beyond the last global position read. With batchSize a batch has at most so many events of the
    category. Spark asks a reader for the end of its first batch before it tells it the start (which may be a checkpoint's),
    so that the first batch after a start or restart takes what is there, dealt to partitions by files. The trigger
    availableNow asks for one end only."""

    def __init__(self, options: dict):
        self.path, self.category = options["path"], options.get("category")
        self.start, self.batch = options.get("startingOffset", "earliest"), int(options.get("batchSize", 0))
        self.parts, self.at = int(options.get("partitions", 4)), None

    def initialOffset(self) -> dict:
        self.at = top(self.path) if self.start == "latest" else 0 if self.start == "earliest" else int(self.start)
        return {"position": self.at}

    def latestOffset(self) -> dict:
        self.at = top(self.path) if self.at is None or not self.batch else after(self.path, self.category, self.at, self.batch)
        return {"position": self.at}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = end["position"]
        return dealt(self.path, start["position"], end["position"], self.parts)

    def read(self, partition: Range):
        yield from rows(self.path, partition.files, self.category, partition.low, partition.high).to_batches()


class CategoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.category, self.parts = options["path"], options.get("category"), int(options.get("partitions", 4))

    def partitions(self) -> list[Range]:
        return dealt(self.path, 0, 2**63 - 1, self.parts)

    def read(self, partition: Range):
        yield from rows(self.path, partition.files, self.category, None, None).to_batches()


class CategoryFeed(DataSource):
    """format("category_feed"): options path, category, startingOffset (earliest, latest or a position), batchSize, partitions."""

    @classmethod
    def name(cls) -> str:
        return "category_feed"

    def schema(self) -> str:
        return FEED

    def reader(self, schema) -> DataSourceReader:
        return CategoryReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CategoryStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CategoryFeed)


@dataclass
class Stats:
    """Counts of a feed by tranche; complete once each tranche has come to its tail with all it read done."""

    pages: dict = field(default_factory=dict)
    empty: dict = field(default_factory=dict)
    events: dict = field(default_factory=dict)
    read: dict = field(default_factory=dict)
    done: dict = field(default_factory=dict)
    tail: dict = field(default_factory=dict)

    def record_batch(self, tranche: str, items: int, checkpoint: int, is_tail: bool) -> None:
        self.pages[tranche] = self.pages.get(tranche, 0) + 1
        self.empty[tranche] = self.empty.get(tranche, 0) + (items == 0)
        self.events[tranche] = self.events.get(tranche, 0) + items
        self.read[tranche], self.tail[tranche] = checkpoint, is_tail

    def record_completion(self, tranche: str, checkpoint: int) -> None:
        self.done[tranche] = checkpoint

    def caught_up(self) -> bool:
        return bool(self.read) and all(self.tail.get(t) and self.done.get(t) == at for t, at in self.read.items())

    def wait_for_tail(self, propagation_delay: float = 0.0, timeout: float | None = None, poll: float = 0.01) -> bool:
        """Waits until every tranche that is known has come to its tail, with all it read done, and at least
        propagation_delay seconds have passed, the time that appended events take to be seen. False after the timeout."""
        began = time.monotonic()
        while not (time.monotonic() - began >= propagation_delay and self.caught_up()):
            if timeout is not None and time.monotonic() - began >= timeout:
                return False
            time.sleep(poll)
        return True

    def dump(self) -> list[dict]:
        return [{"tranche": t, "pages": self.pages[t], "empty": self.empty[t], "events": self.events[t], "read": self.read[t], "completed": self.done.get(t)} for t in sorted(self.pages)]


class TailingFeed:
    """Reads batches of a tranche from its checkpoint and hands them to a sink, a batch at a time.

    crawl(position) gives (items, checkpoint, is_tail); sink(items) returns when they are done. Empty batches skip the
    sink; a tail is followed by a pause. The checkpoint is saved each `every` seconds if it moved, and at the end."""

    def __init__(self, checkpoints, group: str, crawl: Callable, sink: Callable, *, origin: Callable[[], int] | None = None, pause: float = 1.0, every: float = 5.0, stats: Stats | None = None):
        self.checkpoints, self.group, self.crawl, self.sink = checkpoints, group, crawl, sink
        self.origin, self.pause, self.every, self.stats = origin, pause, every, stats or Stats()

    def run(self, tranche: str, until: Callable[[], bool] | None = None) -> int:
        """Runs until `until` says so, by default at the first tail; the last checkpoint."""
        at = self.checkpoints.load(self.group, tranche, self.origin() if self.origin else None)
        saved, when = at, time.monotonic()
        try:
            while True:
                items, after, is_tail = self.crawl(at)
                self.stats.record_batch(tranche, len(items), after, is_tail)
                if items:
                    self.sink(items)
                self.stats.record_completion(tranche, after)
                at = after
                if at != saved and time.monotonic() - when >= self.every:
                    self.checkpoints.save(self.group, tranche, at)
                    saved, when = at, time.monotonic()
                if until() if until else is_tail:
                    return at
                if is_tail:
                    time.sleep(self.pause)
        finally:
            if at != saved:
                self.checkpoints.save(self.group, tranche, at)


class ProgressListener(StreamingQueryListener):
    """Keeps a row a micro-batch: name, batch, rows in, seconds."""

    def __init__(self):
        self.rows: list[tuple[str | None, int, int, float]] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.rows.append((p.name, p.batchId, p.numInputRows, (p.batchDuration or 0) / 1000))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
