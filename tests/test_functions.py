import hashlib

import pytest
from pyspark.sql import functions as F

from rillstone.functions import names as N
from rillstone.operators import codec, scans, snapshots


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("name, category, id_, cardinal, plain", [("Cat-a-b+c", "Cat", "a-b+c", "a-b", False), ("Cat", "Cat", None, None, True), ("Cat:snapshot-1", "Cat:snapshot", "1", "1", False)])
def test_names(spark, name, category, id_, cardinal, plain):
    n = F.lit(name)
    found = spark.range(1).select(N.category(n), N.stream_id(n), N.cardinal_id(n), N.is_category(n)).first()
    assert tuple(found) == (category, id_, cardinal, plain)


def test_hash_is_signed_and_whole(spark):
    values = [str(i) for i in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", N.hash_64("v").alias("h")).collect()
    for r in rows:
        assert r.h == int.from_bytes(hashlib.md5(r.v.encode()).digest()[:8], "big", signed=True)


@pytest.mark.parametrize("bad", [lambda: N.compose(F.lit("a-b"), F.lit("x")), lambda: N.compose(F.lit(""), F.lit("x")), lambda: N.compose(F.lit("a"), F.lit("")), lambda: N.compose(F.lit("a"), F.lit("x_y")), lambda: N.split_name(F.lit("nodash")), lambda: N.split_name(F.lit("-x")), lambda: N.id_elements(F.lit("a_b"), 3), lambda: N.parse_uuid(F.lit("nope"))])
def test_guards(spark, bad):
    with pytest.raises(Exception, match="bad|no uuid"):
        one(spark, bad())


def test_small_functions(spark):
    assert one(spark, N.compose(F.lit("Cat"), F.lit("a"), F.lit("b"))) == "Cat-a_b"
    assert one(spark, N.try_match(F.lit("Cat-1"), "Dog")) is None and one(spark, N.try_match(F.lit("Cat-1"), "Cat")) == "1"
    for meta, version in (('{"streamVersion":"10"}', 11), ('{"version":"10"}', 10), (None, 0), ("{}", 0)):
        assert one(spark, N.snapshot_version(F.lit(meta))) == version
    assert one(spark, N.snapshot_stream(F.lit("Cat-1"))) == "Cat:snapshot-1"
    assert N.quote_identifier("select") == '"select"' and N.quote_identifier("abc") == "abc" and N.quote_identifier('A"b') == '"A""b"'
    assert N.STORE_VERSION == "1.3.0"


def test_scans_check_their_arguments(spark):
    log = spark.createDataFrame([], "stream_name string, category string, position long, global_position long, metadata string")
    for call in (lambda: scans.stream_messages(log, "Cat"), lambda: scans.category_messages(log, "a-b"), lambda: scans.category_messages(log, "a", correlation="b-c"), lambda: scans.category_messages(log, "a", member=1), lambda: scans.category_messages(log, "a", member=3, size=3), lambda: scans.category_messages(log, "a", member=0, size=0)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(PermissionError):
        scans.stream_messages(log, "a-b", condition="1=1")
    with pytest.raises(ValueError):
        codec.match_categories(log)


def test_batch_limit(spark):
    log = spark.createDataFrame([("A-1", i) for i in range(11)], "stream_name string, position long")
    assert scans.batches_read(log, 3).first().n_batches == 4
    assert scans.pages(log, "A-1", 0, 3, 4).count() == 11
    with pytest.raises(Exception, match="Batch limit exceeded"):
        scans.pages(log, "A-1", 0, 3, 3).collect()


def test_members_part_all_streams(spark):
    names = spark.range(100).select(F.concat(F.lit("Cat-"), "id").alias("stream_name"), F.lit("Cat").alias("category"), (F.col("id") + 1).alias("global_position"))
    parts = [{r.stream_name for r in scans.category_messages(names, "Cat", 1, -1, member=m, size=3).collect()} for m in range(3)]
    assert len(set.union(*parts)) == sum(map(len, parts)) == 100


def test_bodies_come_back(spark):
    rows = [("x" * 200,), ("short",), (None,), ("ä" * 60,)]
    df = spark.createDataFrame(rows, "data string").withColumn("c", codec.compressed("data"))
    out = df.select("data", "c.encoding", codec.decompressed("c.encoding", "c.body").alias("back")).collect()
    assert [r.encoding for r in out] == [codec.DEFLATE, codec.RAW, codec.RAW, codec.DEFLATE] and all(r.data == r.back for r in out)


def test_decode_may_fail(spark):
    log = spark.createDataFrame([("A", "{broken"), ("B", "{}")], "type string, data string")
    assert codec.decode(log, {"A": "x int"}).count() == 1
    with pytest.raises(Exception):
        codec.decode(log, {"A": "x int"}, failing=True).collect()


def test_rolling_state_swaps_only_on_its_etag(spark):
    table = spark.createDataFrame([("A-1", "e1")], "stream_name string, etag string")
    rows = spark.createDataFrame([("A-1", "e1"), ("A-1", "e0"), ("B-1", None), ("B-2", "x")], "stream_name string, expected_etag string")
    found = {(r.stream_name, r.expected_etag): r.applied for r in snapshots.swapped(table, rows).collect()}
    assert found == {("A-1", "e1"): True, ("A-1", "e0"): False, ("B-1", None): True, ("B-2", "x"): False}
