import pytest

from rillstone.operators import documents as D
from rillstone.sources.store import Event, WrongExpectedVersion


def add(*names):
    return [Event(n, "x" * 10) for n in names]


def test_a_tip_that_overflows_becomes_a_batch():
    store = D.DocumentStore(max_events=3)
    store.sync("s", None, add("a", "b"), [])
    tip = store.sync("s", 2, add("c"), add("snap"))
    assert (tip.n, [e.type for e in tip.events], tip.appended, tip.before) == (3, ["a", "b", "c"], 1, 0)
    tip = store.sync("s", tip.etag, add("d", "e"), [])
    assert (tip.n, [e.type for e in tip.events], tip.appended, tip.before, tip.unfolds) == (5, ["d", "e"], 2, 33, [])
    assert [(i, [e.type for e in es]) for i, es in store.before_tip("s")] == [(0, ["a", "b", "c"])]
    for expected in (3, None, "other"):
        with pytest.raises(WrongExpectedVersion):
            store.sync("s", expected, add("x"), [])
    with pytest.raises(ValueError):
        store.sync("s", 5, [], [])
    # by bytes; an empty tip never calves
    store = D.DocumentStore(max_event_bytes=25, max_bytes=40)
    assert len(store.sync("s", 0, add("a", "b", "c"), []).events) == 3 and not store.batches
    assert len(store.sync("s", 3, [], add("u")).events) == 0 and store.batches["s"][0][0] == 0


def totals(access):
    return D.DocumentCategory(D.DocumentStore(max_events=4), "C", lambda s, es: _fold(s, es), 0, access)


def _fold(state, events):
    for e in events:
        state = int(e.data) if e.type == "Snapshot" else state + int(e.data)
    return state


def steps(s):
    return [Event("Added", str(s + 1))]


@pytest.mark.parametrize(
    "access, events, unfolds",
    [
        (D.UNOPTIMIZED, 5, 0),
        (D.snapshot(lambda e: e.type == "Snapshot", lambda s: Event("Snapshot", str(s))), 5, 1),
        (D.multi_snapshot(lambda e: e.type == "Snapshot", lambda s: [Event("Snapshot", str(s - 1)), Event("Added", "1")]), 5, 2),
        (D.rolling_state(lambda s: Event("Snapshot", str(s))), 0, 1),
        (D.custom(lambda e: e.type == "Snapshot", lambda es, s: ([e for e in es if int(e.data) % 2], [Event("Snapshot", str(s))])), 1, 1),
    ],
)
def test_access_strategies_give_one_state(access, events, unfolds):
    category = totals(access)
    for k in range(5):
        category.decider("1").transact(steps)
    tip = category.store.tip("C-1")
    assert category.decider("1").query() == 31
    assert (tip.n, len(tip.unfolds)) == (events, unfolds)
    again = D.DocumentCategory(category.store, "C", category.fold, 0, access)
    assert again.load("C-1").state == 31


def test_rolling_state_is_guarded_by_etag():
    access = D.rolling_state(lambda s: Event("Snapshot", str(s)))
    one = totals(access)
    two = D.DocumentCategory(one.store, "C", one.fold, 0, access)
    one.decider("1").transact(steps)
    first = two.load("C-1")
    one.decider("1").transact(steps)
    with pytest.raises(WrongExpectedVersion):
        two.sync("C-1", first, [Event("Added", "100")])
    assert two.decider("1").transact(lambda s: [Event("Added", str(s))]) == 0 and two.decider("1").query() == 6


def test_latest_known_event():
    category = D.DocumentCategory(D.DocumentStore(), "C", lambda s, es: es[-1].data, None, D.LATEST_KNOWN_EVENT)
    for k in range(3):
        category.decider("1").transact(lambda s, k=k: [Event("Set", str(k))])
    assert category.load("C-1").state == "2" and category.store.tip("C-1").n == 3


def test_many_appends_follow_the_same_rule(spark):
    import random

    rnd = random.Random(5)
    stores, tips, requests = {}, [], []
    for k in range(60):
        store = stores[f"s{k}"] = D.DocumentStore(max_events=6, max_event_bytes=90, max_bytes=120)
        had = add(*("abcdef"[: rnd.randint(0, 6)]))
        tip = store.sync(f"s{k}", 0, had, []) if had else D.Tip()
        if had:
            tips.append((f"s{k}", tip.n, tip.etag, [(i, e.type, e.data) for i, e in enumerate(tip.events)], [], tip.before))
        version, etag = (tip.n, None) if rnd.random() < 0.5 else (None, tip.etag)
        version = version if rnd.random() < 0.8 or version is None else version + 1
        requests.append((f"s{k}", version if had else 0, etag, [(None, e.type, e.data) for e in add(*("uvwxyz"[: rnd.randint(1, 6)]))], [("snap", "y" * rnd.randint(0, 60))]))
    shape = f"e array<{D.EVENT}>, u array<{D.UNFOLD}>"
    found = D.appended(
        spark.createDataFrame(tips, f"stream_name string, n long, etag string, {shape}, b long"),
        spark.createDataFrame(requests, f"stream_name string, expected_version long, expected_etag string, events array<{D.EVENT}>, unfolds array<{D.UNFOLD}>"),
        6, 90, 120,
    ).collect()
    outcomes = {}
    for stream, version, etag, events, unfolds in requests:
        store, own = stores[stream], [r for r in found if r.stream_name == stream]
        try:
            tip = store.sync(stream, etag or version, [Event(t, d) for _, t, d in events], [Event(*u) for u in unfolds])
        except WrongExpectedVersion:
            assert [r.outcome for r in own] == ["ConflictUnknown"]
            outcomes["conflict"] = 1
            continue
        rows = {r.kind: r for r in own}
        t = rows["tip"]
        assert (t.n, t.a, t.b, t.c, [tuple(x) for x in t.u]) == (tip.n, tip.appended, tip.before, [e.type for e in tip.events], unfolds)
        assert [e.position for e in t.e] == list(range(t.i, t.n))
        assert ("batch" in rows) == bool(store.batches)
        if store.batches:
            first, events_ = store.batches[stream][0]
            assert (rows["batch"].i, rows["batch"].c) == (first, [e.type for e in events_])
        outcomes[len(rows)] = 1
    assert len(outcomes) == 3
