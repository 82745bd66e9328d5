"""The message log and the logs that are derived from driver tables.

Schema of a log: global_position, stream_name, category, position, type, data, metadata, time, id, is_unfold. Logs that
come from driver tables also carry the numbers that their bodies hold, so that folds needn't parse JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import read

SCHEMA = T.StructType(
    [
        T.StructField("global_position", T.LongType()),
        T.StructField("stream_name", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("data", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("id", T.StringType()),
        T.StructField("is_unfold", T.BooleanType()),
    ]
)


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream a user. Windows run over stream_name, so that a filter on it reaches the scan's side of the window."""
    e = read(spark, sf_dir, "events").withColumn("stream_name", F.concat(F.lit("User-"), F.col("user_id").cast("string")))
    return e.select(
        (F.col("event_id") + 1).alias("global_position"),
        "stream_name",
        F.lit("User").alias("category"),
        (F.row_number().over(Window.partitionBy("stream_name").orderBy("event_id")) - 1).cast("long").alias("position"),
        F.col("event_type").alias("type"),
        F.to_json(F.struct("value")).alias("data"),
        F.col("props").alias("metadata"),
        F.col("ts").alias("time"),
        F.md5(F.col("event_id").cast("string")).alias("id"),
        F.lit(False).alias("is_unfold"),
        "value",
    )


def conv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream a conversation; its turns are positions already."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("global_position"),
        F.concat(F.lit("Conversation-"), F.col("conv_id").cast("string")).alias("stream_name"),
        F.lit("Conversation").alias("category"),
        F.col("turn").alias("position"),
        F.col("role").alias("type"),
        F.col("text").alias("data"),
        F.lit(None).cast("string").alias("metadata"),
        F.lit(None).cast("timestamp_ntz").alias("time"),
        F.lit(None).cast("string").alias("id"),
        F.lit(False).alias("is_unfold"),
    )


def invoice_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream an order: InvoiceRaised, PaymentReceived for each line, InvoiceFinalized where the order is filled.

    (l_orderkey, l_linenumber) is not unique, so payments are ordered by all that tells them apart.
    """
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    money = lambda c: F.col(c).cast("decimal(18,2)").alias("amount")
    none = lambda k, n: F.lit(None).cast(k).alias(n)
    raised = o.select(F.col("o_orderkey").alias("key"), F.lit("InvoiceRaised").alias("type"), money("o_totalprice"), F.col("o_custkey").alias("payer"), none("string", "reference"), F.lit(0).alias("phase"), none("int", "l1"), none("long", "l2"), none("long", "l3"), none("double", "l4"))
    reference = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("reference")
    paid = li.select(F.col("l_orderkey").alias("key"), F.lit("PaymentReceived").alias("type"), money("l_extendedprice"), none("long", "payer"), reference, F.lit(1).alias("phase"), F.col("l_linenumber").alias("l1"), F.col("l_partkey").alias("l2"), F.col("l_suppkey").alias("l3"), F.col("l_quantity").alias("l4"))
    done = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), F.lit("InvoiceFinalized").alias("type"), none("decimal(18,2)", "amount"), none("long", "payer"), none("string", "reference"), F.lit(2).alias("phase"), none("int", "l1"), none("long", "l2"), none("long", "l3"), none("double", "l4"))
    every = raised.unionByName(paid).unionByName(done).withColumn("stream_name", F.concat(F.lit("Invoice-"), F.col("key").cast("string")))
    order = Window.partitionBy("stream_name").orderBy("phase", "l1", "l2", "l3", "amount", "l4")
    return every.select(
        "stream_name", F.lit("Invoice").alias("category"), (F.row_number().over(order) - 1).cast("long").alias("position"), "type", "amount", "payer", "reference"
    )


def redelivered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_log in which every third event of a stream comes again; delivery is 0 or 1."""
    log = user_log(spark, sf_dir)
    again = log.where("position % 3 = 1").withColumn("delivery", F.lit(1))
    return log.withColumn("delivery", F.lit(0)).unionByName(again)


def gappy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_log(spark, sf_dir).where("position % 7 <> 3")


def correlated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_log whose metadata names the session an event belongs to and the event that caused it: each run of five
    events of a stream is a session, and an event is caused by the one before it."""
    log = user_log(spark, sf_dir)
    order = Window.partitionBy("stream_name").orderBy("position")
    session = F.concat(F.substring("stream_name", 6, 20), F.lit("_"), F.expr("position div 5").cast("string"))
    cause = F.when(F.col("position") % 5 == 0, F.col("global_position")).otherwise(F.lag("global_position").over(order))
    return log.withColumn(
        "metadata",
        F.to_json(
            F.struct(
                session.alias("$correlationId"),
                cause.cast("string").alias("$causationId"),
                F.concat(F.when(F.col("position") % 2 == 0, "Session-").otherwise("Device-"), session).alias("correlationStreamName"),
            )
        ),
    )
