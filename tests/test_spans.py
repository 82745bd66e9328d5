import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rillstone.operators import epochs as E
from rillstone.operators import spans as S


def mk(start, n):
    return S.Span(start, tuple(str(i) for i in range(start, start + n)))


@pytest.mark.parametrize(
    "low, parts, wanted",
    [
        (0, [(0, 0), (0, 0)], []), (1, [(0, 1), (0, 0)], []), (0, [(0, 1), (2, 2)], [(0, 1), (2, 2)]), (0, [(0, 1), (0, 2)], [(0, 2)]),
        (1, [(0, 1), (0, 2)], [(1, 1)]), (0, [(0, 1), (1, 2)], [(0, 3)]), (2, [(0, 1), (1, 2)], [(2, 1)]), (2, [(0, 1), (2, 1)], [(2, 1)]),
        (1, [(0, 2), (2, 2)], [(1, 3)]), (1, [(0, 2), (2, 2), (5, 1)], [(1, 3), (5, 1)]), (11614, [(0, 0), (11614, 1)], [(11614, 1)]), (11613, [(11614, 1), (0, 0)], [(11614, 1)]),
    ],
)
def test_merge(low, parts, wanted):
    assert S.merge(low, [mk(*p) for p in parts]) == [mk(*p) for p in wanted]


@pytest.mark.parametrize("low, part, wanted", [(2, (0, 1), (2, 0)), (2, (1, 2), (2, 1)), (1, (0, 2), (1, 1)), (1, (2, 2), (2, 2)), (1, (5, 1), (5, 1))])
def test_drop_before(low, part, wanted):
    assert S.drop_before(low, mk(*part)) == mk(*wanted)


parts = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 5)), max_size=6)


@given(parts, st.integers(0, 8), st.randoms())
def test_merge_is_idempotent_and_blind_to_order(found, low, rnd):
    spans = [mk(*p) for p in found]
    once = S.merge(low, spans)
    assert S.merge(low, once) == once
    rnd.shuffle(spans)
    assert S.merge(low, spans) == once
    assert [int(e) for s in once for e in s.events] == sorted({i for a, n in found for i in range(a, a + n) if i >= low})


def test_gap_predicate():
    assert not S.has_gap(3, -2) and S.has_gap(3, 2) and not S.has_gap(2, 2) and not S.has_gap(None, 2)


def test_flatten_raises_on_a_gap(spark):
    rows = spark.createDataFrame([("A-1", 0, ["a"]), ("A-1", 2, ["b"])], "stream_name string, i long, c array<string>")
    with pytest.raises(Exception, match="gap within a batch"):
        S.flatten(rows).collect()


def span(n, i=0, types="AB"):
    return E.StreamSpan(f"Cat-stream{n}", i, tuple(types))


def test_epoch_rules():
    never = lambda e, n: False
    closed = E.Epoch()
    closed.ingest([E.StreamSpan("Cat-Id", 0, ("a", "a"))], never)
    open_ = E.Epoch([list(c) for c in closed.changes], dict(closed.heads))
    closed.closed = True
    again = [E.StreamSpan("Cat-Id", 1, ("a", "b"))]
    assert closed.ingest(again, never) == ([], [E.StreamSpan("Cat-Id", 2, ("b",))])
    assert open_.ingest(again, never) == (["Cat-Id"], [])
    assert open_.changes[-1] == [E.StreamSpan("Cat-Id", 2, ("b",))]
    assert open_.ingest(again, never) == ([], [])
    with pytest.raises(E.GapError, match="Cat-Id: span at 4 where 3 was to follow"):
        open_.ingest([E.StreamSpan("Cat-Id", 4, ("z",))], never)
    assert closed.ingest([E.StreamSpan("Cat-Id", 9, ("z",))], never) == ([], [E.StreamSpan("Cat-Id", 9, ("z",))])
    with pytest.raises(ValueError, match="filtered"):
        open_.ingest([E.StreamSpan("$AppendsEpoch-0_1", 0, ("z",))], never)


def test_epochs_roll_over_and_repeat_across_epochs():
    index = E.Index(max_version=2)
    for _ in range(10):
        for n in range(1, 6):
            index.ingest([span(n)])
    # the version is that before the append, so the third one closes an epoch
    assert index.active == 16
    assert [(e, k, s) for e, k, s, i, c in index.rows()] == [(j // 3, j % 3, f"Cat-stream{j % 5 + 1}") for j in range(50)]
    assert [x.closed for _, x in sorted(index.epochs.items())] == [True] * 16 + [False]


def test_residual_goes_to_the_next_epoch():
    index = E.Index()
    index.ingest([span(1), span(2)])
    index.epochs[0].closed = True
    index.ingest_many([(0, span(1, 1, "BC")), (0, span(2))])
    assert index.rows()[-1] == (1, 0, "Cat-stream1", 2, ["C"]) and index.active == 1


def test_bulk_classes_equal_the_epoch(spark):
    rnd = random.Random(3)
    heads = {f"S-{k}": rnd.randint(0, 6) for k in range(8)}
    spans = {(f"S-{rnd.randint(0, 11)}", rnd.randint(0, 8)): tuple(str(x) for x in range(rnd.randint(1, 5))) for _ in range(60)}
    known = spark.createDataFrame(list(heads.items()), "stream_name string, next_index long")
    rows = spark.createDataFrame([(s, i, list(c)) for (s, i), c in spans.items()], "stream_name string, i long, c array<string>")
    for r in E.classify(rows, known).collect():
        whole = E.StreamSpan(r.stream_name, r.i, spans[r.stream_name, r.i])
        epoch = E.Epoch(heads=dict(heads))
        if r.outcome == "gap":
            with pytest.raises(E.GapError):
                epoch.fresh(whole)
        else:
            fresh = epoch.fresh(whole)
            assert (fresh.types if fresh else ()) == tuple(r.fresh)
            assert r.outcome == ("start" if r.stream_name not in heads else "append" if fresh else "discard")


def test_a_stored_index_takes_spans_once(spark, tmp_path):
    from rillstone.sources.indexes import StoredIndex
    from rillstone.sources.store import LogStore

    store = LogStore(spark, f"file://{tmp_path}/log")
    index, plain = StoredIndex(store, max_version=2), E.Index(max_version=2)
    for k in range(5):
        spans = [span(n, 2 * k) for n in range(1, 4)]
        assert index.ingest(spans) == plain.ingest(spans)
        assert index.ingest(spans[:2]) == plain.ingest(spans[:2])
    again = StoredIndex(LogStore(spark, f"file://{tmp_path}/log"), max_version=2)
    assert again.active() == plain.active > 0
    assert sorted((r.epoch, r.ordinal, r.stream_name, r.i, r.c) for r in again.changes().collect()) == sorted(plain.rows())
    # another writer comes between reading and writing: nothing is lost or taken twice
    other, real, met = StoredIndex(LogStore(spark, f"file://{tmp_path}/log"), max_version=2), store.replace, []

    def late(name, rows, expected=LogStore.ANY):
        if not met:
            met.append(other.ingest([span(7), span(8)]))
        real(name, rows, expected)

    store.replace = late
    assert index.ingest([span(8), span(9)]) == ["Cat-stream9"] and met == [["Cat-stream7", "Cat-stream8"]]
    got = [(r.stream_name, r.i) for r in index.changes().collect()]
    assert {("Cat-stream7", 0), ("Cat-stream8", 0), ("Cat-stream9", 0)} <= set(got) and len(got) == len(set(got))
