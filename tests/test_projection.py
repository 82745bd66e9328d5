import pytest

from rillstone.operators.projection import change, collapse, project

ROWS = "id string, seq int, action string, data map<string,string>"


def folded(spark, changes):
    rows = [("1", k, c["action"], c["data"]) for k, c in enumerate(changes)]
    found = collapse(spark.createDataFrame(rows, ROWS), "id").collect()
    return {"action": found[0].action, "data": found[0].data} if found else None


I, U, P, D = (lambda a: lambda **d: change(a, **d))("Insert"), (lambda a: lambda **d: change(a, **d))("Update"), (lambda a: lambda **d: change(a, **d))("Upsert"), (lambda a: lambda **d: change(a, **d))("Delete")  # noqa: E741, E501


@pytest.mark.parametrize(
    "changes, wanted",
    [
        ([I(id=1, name="bob", age=30), U(id=1, name="bob", age=31), D(id=1)], None),
        ([I(id=1, name="bob", age=30), U(id=1, name="bobby", age=31), U(id=1, age=32)], I(id=1, name="bobby", age=32)),
        ([I(id=1, name="bob", age=30), D(id=1), I(id=1, name="bobby", age=31)], I(id=1, name="bobby", age=31)),
        ([P(id=1, name="bob", age=30), P(id=1, name="bobby", age=31)], P(id=1, name="bobby", age=31)),
        ([P(id=1, name="bob", age=30), D(id=1), P(id=1, name="bobby", age=31)], P(id=1, name="bobby", age=31)),
        ([I(id=1, name="bob", age=30), U(id=1, name="bobby", age=31), D(id=1), I(id=1, name="bobby", age=32), P(id=1, name="bobby", age=33), U(id=1, name="blob")], I(id=1, name="blob", age=33)),
        ([D(id=1), I(id=1, name="x")], P(id=1, name="x")),
        ([U(id=1, name="a"), D(id=1)], D(id=1)),
        ([U(id=1, name="a"), P(id=1, age=2)], P(id=1, age=2)),
    ],
)
def test_collapse(spark, changes, wanted):
    assert folded(spark, changes) == wanted


@pytest.mark.parametrize("changes", [[I(id=1), I(id=1)], [U(id=1), I(id=1)], [P(id=1), I(id=1)], [D(id=1), U(id=1)]])
def test_what_cannot_follow_raises(spark, changes):
    with pytest.raises(Exception, match="can't follow"):
        folded(spark, changes)


def run(spark, batches, schema="id string, name string, version long", keys=("id",), version="version"):
    table = spark.createDataFrame([], schema)
    for batch in batches:
        names = [f"{k} string" for k in keys]
        rows = [(*[c["data"][k] for k in keys], n, c["action"], c["data"]) for n, c in enumerate(batch)]
        changes = spark.createDataFrame(rows, f"{', '.join(names)}, seq int, action string, data map<string,string>")
        done = project(table, changes, list(keys), version).collect()
        table = spark.createDataFrame(done, schema)
    return [tuple(r) for r in table.collect()]


def v(make, n, **d):
    return make(id="a", version=n, **d)


@pytest.mark.parametrize(
    "batches, wanted",
    [
        ([[v(I, 10, name="bob")], [v(U, 2, name="bobby")]], [("a", "bob", 10)]),
        ([[v(I, 0, name="bob")], [v(D, 1)]], []),
        ([[v(I, 10, name="bob")], [v(D, 2)]], [("a", "bob", 10)]),
        ([[v(I, 0, name="bob")], [v(U, 1, name="bobby")], [v(D, 2)], [v(I, 3, name="bob")], [v(D, 2)]], [("a", "bob", 3)]),
        ([[v(I, 10, name="bob")], [v(P, 2, name="bobby")]], [("a", "bob", 10)]),
        ([[v(I, 1, name="bob"), v(U, 2, name="bobby"), v(D, 3), v(U, 4, name="bobby"), v(D, 5), v(I, 6, name="bobby2"), v(U, 7, name="bobby3"), v(D, 8), v(I, 9, name="bobby2"), v(U, 10, name="bobby4")]], [("a", "bobby4", 10)]),
        ([[v(I, 1, name="bob")], [v(U, 2, name="bobby")], [v(D, 3)], [v(U, 2, name="bobby")], [v(D, 3)], [v(I, 4, name="b2")], [v(U, 5, name="b3")], [v(I, 4, name="b2")], [v(U, 5, name="b3")]], [("a", "b3", 5)]),
    ],
)
def test_versions(spark, batches, wanted):
    assert run(spark, batches) == wanted


def test_composite_key_without_version(spark):
    schema = "id string, tenant string, name string, age int"
    k = {"id": "a", "tenant": "t"}
    out = run(spark, [[I(**k, name="bob", age=30), U(**k, name="bobby"), U(**k, age=111)], [I(**k, name="no", age=1)]], schema, ("id", "tenant"), None)
    assert out == [("a", "t", "bobby", 111)]
    assert run(spark, [[I(**k, name="bob", age=30)], [D(**k, name="other")]], schema, ("id", "tenant"), None) == [("a", "t", "bob", 30)]
    assert run(spark, [[I(**k, name="bob", age=30)], [D(**k)]], schema, ("id", "tenant"), None) == []


def test_handler_keeps_a_read_model(spark, tmp_path):
    from rillstone.operators.projection import handler
    from rillstone.sources.store import LogStore

    store = LogStore(spark, f"file://{tmp_path}/log")
    store.replace("people", spark.createDataFrame([], "id string, name string, version long"))
    batch = spark.createDataFrame([("a", 0, "Insert", {"id": "a", "name": "bob", "version": "1"})], ROWS)
    keep = handler(store, "people", ["id"], "version", lambda b: b)
    keep(batch, 0)
    keep(batch, 0)
    assert [tuple(r) for r in store.read("people").collect()] == [("a", "bob", 1)]


def test_builders_need_their_keys():
    import pytest

    from rillstone.operators import projection

    build = projection.changes_for(("id", "tenant"), ("name",))
    assert build["Upsert"](id=1, tenant="t", name=None) == {"action": "Upsert", "data": {"id": "1", "tenant": "t", "name": None}}
    assert set(build) == {"Insert", "Update", "Upsert", "Delete"}
    for wrong in ({"id": 1}, {"id": 1, "tenant": None}, {"id": 1, "tenant": 2, "age": 3}):
        with pytest.raises(ValueError):
            build["Delete"](**wrong)
