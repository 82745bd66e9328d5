import pytest

from rillstone.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, same):
    same(QUERIES[name], ORACLE_SQL[name])


def test_entry_is_the_summary(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cart_follows_a_plain_fold(spark):
    from rillstone.operators import folds

    events = [
        ("c", "ItemAdded", "a", 1, None, None), ("c", "ItemAdded", "b", 2, True, None), ("c", "ItemAdded", "a", 3, None, None), ("c", "ItemQuantityChanged", "a", 0, None, None),
        ("c", "ItemPropertiesChanged", "b", None, False, None), ("d", "ItemAdded", "x", 9, None, None), ("d", "Snapshotted", None, None, None, [("y", 4, None), ("z", 5, True)]),
        ("d", "ItemAdded", "x", 1, None, None), ("d", "ItemRemoved", "y", None, None, None), ("e", "ItemAdded", "q", 1, None, None), ("e", "ItemRemoved", "q", None, None, None),
    ]
    rows, at = [], {}
    for s, *rest in events:
        rows.append((s, at.setdefault(s, 0), *rest))
        at[s] += 1
    log = spark.createDataFrame(rows, f"stream_name string, position long, type string, sku string, quantity long, waived boolean, items {folds.CART}")
    found = {r.stream_name: ([tuple(x) for x in r.state], r.version) for r in folds.cart(log).collect()}
    # the last added line comes first, a quantity of 0 stays, a snapshot replaces
    assert found == {"c": ([("a", 0, None), ("b", 2, False), ("a", 0, None)], 5), "d": ([("x", 1, None), ("z", 5, True)], 4), "e": ([], 2)}


def test_causation_of_any_depth(spark):
    from rillstone.operators import views

    chain = [(k, max(0, k - 1)) for k in range(400)]  # one chain of 400 events
    other = [(1000, 1000), (1001, 1000), (1002, 1001), (2000, 1999), (2001, 2000), (3000, 3001), (3001, 3000), (4000, None)]
    found = {r.id: (r.root, r.level) for r in views.causation_tree(spark.createDataFrame(chain + other, "id long, cause long")).collect()}
    assert found == {k: (0, k) for k in range(400)} | {1000: (1000, 0), 1001: (1000, 1), 1002: (1000, 2)}
    assert views.causation_tree(spark.createDataFrame([], "id long, cause long")).count() == 0


def test_load_raises_for_a_missing_origin(spark):
    from rillstone.operators import scans

    log = spark.createDataFrame([("s", 3, "a"), ("s", 4, "b")], "stream_name string, position long, type string")
    with pytest.raises(Exception, match="origin event not found in s"):
        scans.loaded(log.where("position = 4"), log.where("position = 3")).collect()
    assert scans.loaded(log.where("position = 4"), log.where("position = 3"), ignore_missing=True).count() == 2


def test_walk_gives_pages(spark):
    from rillstone.operators import scans

    log = spark.range(7).selectExpr("'s' as stream_name", "id as position")
    assert [[r.position for r in p] for p in scans.walk(log, "s", max_items=3)] == [[0, 1, 2], [3, 4, 5], [6]]
    assert [[r.position for r in p] for p in scans.walk(log, "s", backwards=True, max_items=5)] == [[6, 5, 4, 3, 2], [1, 0]]
