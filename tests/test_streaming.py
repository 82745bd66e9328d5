import pytest

from rillstone.streaming import feed as F
from rillstone.streaming import reactor as R


def play(batches, handler=lambda s, es: R.ALL, complete=False):
    seen, done, runs = [], [], []

    def handle(stream, events):
        result = handler(stream, events)
        runs.append(len(events))
        after = R.next_index(events[0][0], len(events), result)
        seen.extend(i for i, _ in events if i < after)
        return result

    d = R.Dispatcher(handle, complete)
    for k, batch in enumerate(batches):
        d.post([("Cat-stream", i, ("T", None)) for i in batch], lambda k=k: done.append(k))
        for _ in range(12):
            d.process()
    return seen, done, runs


def test_each_event_is_handled_once():
    assert play([[0, 1, 2, 3, 4, 2], [5, 3, 6, 1, 7, 3]])[:2] == (list(range(8)), [0, 1])


def test_gaps_are_passed_or_waited_for():
    assert play([[0, 1, 3, 4]])[::2] == ([0, 1, 3, 4], [2, 2])
    assert play([[0, 1, 3, 4]], complete=True)[:2] == ([0, 1], [])
    assert play([[0, 1, 3, 4], [2]], complete=True)[:2] == ([0, 1, 2, 3, 4], [0, 1])


def test_partial_none_and_override():
    assert play([range(10)], lambda s, es: R.partial(2))[2] == [10, 8, 6, 4, 2]
    assert play([range(3)], lambda s, es: R.NONE)[1] == []
    seen, done, _ = play([range(10), range(10, 20), range(20, 22)], lambda s, es: R.override(20) if es[0][0] == 0 else R.ALL)
    assert seen == [*range(10), 20, 21] and done == [0, 1, 2]


def test_batches_complete_in_order():
    waits = {"on": True}
    d, done = R.Dispatcher(lambda s, es: R.NONE if s == "A-1" and waits["on"] else R.ALL), []
    d.post([("A-1", 0, ())], lambda: done.append(0))
    d.post([("B-1", 0, ())], lambda: done.append(1))
    d.process()
    assert done == []
    waits["on"] = False
    d.process()
    assert done == [0, 1]


class Memory(dict):
    def load(self, group, tranche, origin=None):
        return self.get((group, tranche), origin or 0)

    def save(self, group, tranche, position):
        self[group, tranche] = position


def test_a_feed_resumes_from_its_checkpoint():
    log = [(f"A-{i % 2}", i) for i in range(8)]
    crawl = lambda at: (log[at : at + 3], min(at + 3, len(log)), at >= len(log))
    points, got = Memory(), []
    feed = F.TailingFeed(points, "g", crawl, got.extend)
    assert feed.run("A") == 8 and got == log and points == {("g", "A"): 8}
    assert feed.stats.caught_up() and feed.stats.dump()[0]["pages"] == 4
    log.append(("A-9", 8))
    F.TailingFeed(points, "g", crawl, got.extend).run("A")
    assert got == log


def test_a_failing_sink_keeps_what_was_done():
    def sink(items):
        if items[0] == 3:
            raise RuntimeError("no")

    points = Memory()
    with pytest.raises(RuntimeError):
        F.TailingFeed(points, "g", lambda at: ([at], at + 1, False), sink).run("A")
    assert points == {("g", "A"): 3}


def rows_of(path, spark, schema):
    return sorted(map(tuple, spark.read.schema(schema).parquet(path).collect()))


def test_the_reactor_survives_a_restart(spark, tmp_path):
    schema = "stream_name string, position long, type string, data string"
    out = []
    for k, batch in enumerate([[0, 1, 2, 3, 4, 2], [5, 3, 6, 1, 7, 3]]):
        spark.createDataFrame([("Cat-1", i, "T", None) for i in batch], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        R.run_once(events, R.take_all, f"{tmp_path}/cp", lambda b, n, k=k: out.append((k, sorted(r.position for r in b.collect()))))
    assert [x for x in out if x[1]] == [(0, [0, 1, 2, 3, 4]), (1, [5, 6, 7])]


def test_the_reactor_waits_for_the_missing_event(spark, tmp_path):
    schema = "stream_name string, position long, type string, data string"
    out = []
    for batch in [[0, 1], [3, 4], [2]]:
        spark.createDataFrame([("Cat-1", i, "T", None) for i in batch], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        R.run_once(events, R.take_all, f"{tmp_path}/cp", lambda b, n: out.append(sorted(r.position for r in b.collect())), require_complete=True)
    assert [x for x in out if x] == [[0, 1], [2, 3, 4]]


def test_the_category_source(spark, sf, tmp_path):
    from rillstone.sources import logs

    columns = F.NAMES
    log = logs.user_log(spark, sf).select(*columns)
    log.where("global_position <= 600").coalesce(2).write.parquet(f"{tmp_path}/log")
    F.register(spark)
    assert spark.read.format("category_feed").option("path", f"{tmp_path}/log").option("category", "User").load().count() == 600
    got = []

    def once():
        stream = spark.readStream.format("category_feed").option("path", f"{tmp_path}/log").option("category", "User").load()
        q = stream.writeStream.foreachBatch(lambda b, n: got.extend(r[0] for r in b.select("global_position").collect()))
        q.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()

    once()
    once()
    assert sorted(got) == list(range(1, 601))
    log.where("global_position > 600").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    once()
    assert sorted(got) == [r[0] for r in log.select("global_position").orderBy("global_position").collect()]


def test_the_category_source_in_batches(spark, tmp_path):
    """Batches of at most batchSize events, of published files alone."""
    from rillstone.sources.store import ConcurrentWrite, LogStore

    store = LogStore(spark, f"file://{tmp_path}/log")
    rows = lambda c, low, high: spark.createDataFrame([(f"{c}-{k % 3}", k, "T", None, None, None) for k in range(low, high)], "stream_name string, n long, type string, data string, metadata string, id string")
    store.append_frame(rows("A", 0, 30).unionByName(rows("B", 0, 30)))
    store.append_frame(rows("A", 30, 47))
    store.replace("t", spark.range(3))
    publish = store._publish

    def fails(manifest):
        raise ConcurrentWrite

    store._publish, drop, store._drop = fails, store._drop, lambda at: None
    try:
        store.append_frame(rows("A", 99, 120), attempts=1)
    except ConcurrentWrite:
        pass
    store._publish, store._drop = publish, drop
    F.register(spark)
    path = f"file://{tmp_path}/log"
    assert spark.read.format("category_feed").option("path", path).option("category", "A").load().count() == 47
    assert F.after(path, "A", 0, 10) < F.after(path, "A", 0, 11) < F.top(path) == F.after(path, "A", 0, 1000)
    got = []
    stream = spark.readStream.format("category_feed").option("path", path).option("category", "A").option("batchSize", 10).load()
    q = stream.writeStream.foreachBatch(lambda b, n: got.append([r[0] for r in b.select("global_position").collect()])).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    store.append_frame(rows("A", 47, 84))
    q.processAllAvailable()
    q.stop()
    sizes = [len(x) for x in got if x]
    assert sum(sizes) == 84 and max(sizes[1:]) <= 10 and len(sizes) >= 5
    assert sorted(sum(got, [])) == sorted(r[0] for r in store.log().where("category = 'A'").select("global_position").collect())


def test_states_of_a_stream_combine():
    a, b = R.StreamState(3, {3: ("x", None), 5: ("z", None)}), R.StreamState(R.UNKNOWN, {1: ("u", None), 4: ("y", None)})
    a.combine(b)
    assert (a.write, sorted(a.waiting)) == (3, [3, 4, 5])
    b.combine(a)
    assert (b.write, sorted(b.waiting)) == (3, [3, 4, 5])
    a.combine(R.StreamState(R.MALFORMED, {}))
    assert a.malformed and list(a.react("s", R.take_all, False)) == []
    a.combine(R.StreamState(9, {}))
    a.move(9)
    assert a.malformed


def test_waiting_for_the_tail():
    import threading
    import time

    stats = F.Stats()
    assert not stats.wait_for_tail(timeout=0.05)

    def feed():
        time.sleep(0.1)
        stats.record_batch("a", 3, 3, False)
        stats.record_completion("a", 3)
        time.sleep(0.1)
        stats.record_batch("a", 0, 3, True)
        stats.record_completion("a", 3)

    thread, began = threading.Thread(target=feed), time.monotonic()
    thread.start()
    assert stats.wait_for_tail(0.4, timeout=5) and time.monotonic() - began >= 0.4
    thread.join()
