"""Codecs: bodies to columns and back, and the predicates that go with them. Unknown events are dropped, never errors."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as N

RAW, DEFLATE, BROTLI = 0, 1, 2


def decode(log: DataFrame, schemas: dict[str, str], failing: bool = False) -> DataFrame:
    """log with a column a type of body, parsed by its schema where the type matches; events of other types go.

    A missing body gives null. A malformed one gives null too, or an error if `failing`."""
    options = {"mode": "FAILFAST"} if failing else {}
    kept = log.where(F.col("type").isin(*schemas))
    return kept.withColumns({t: F.when(F.col("type") == t, F.from_json("data", s, options)) for t, s in schemas.items()})


def encode(events: DataFrame, body: Column, map_meta: Column | None = None) -> DataFrame:
    """events with data as JSON of `body`, and metadata as JSON of `map_meta` where that is given."""
    out = events.withColumn("data", F.to_json(body))
    return out if map_meta is None else out.withColumn("metadata", F.to_json(map_meta))


def upcast(log: DataFrame, bodies: dict[str, Column]) -> DataFrame:
    """log with `body`, made by its type's expression from the columns of the log; events of other types, and those
    whose expression gives null, go."""
    body = F.lit(None)
    for t, c in bodies.items():
        body = F.when(F.col("type") == t, c).otherwise(body)
    return log.where(F.col("type").isin(*bodies)).withColumn("body", body).where("body is not null")


def keep(log: DataFrame, predicate: Column) -> DataFrame:
    return log.where(predicate)


def keep_types(log: DataFrame, types) -> DataFrame:
    return log.where(F.col("type").isin(*types))


def keep_map(values: Column, f, backwards: bool = False) -> Column:
    """An array mapped, without nulls, in either direction."""
    out = F.filter(F.transform(values, f), lambda x: x.isNotNull())
    return F.reverse(out) if backwards else out


def match_category(log: DataFrame, category: str) -> DataFrame:
    """Events of one category with their stream's id; raises for names without both parts."""
    return log.where(N.category("stream_name") == category).withColumn("stream_id", N.split_name("stream_name")["id"])


def match_categories(log: DataFrame, categories=None, stream_filter: Column | None = None) -> DataFrame:
    if not categories and stream_filter is None:
        raise ValueError("categories or a stream filter are needed")
    found = log if not categories else log.where(N.category("stream_name").isin(*categories) & ~N.is_category("stream_name"))
    return found if stream_filter is None else found.where(stream_filter)


def index_range(log: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    found = log if low is None else log.where(F.col("position") >= low)
    return found if high is None else found.where(F.col("position") <= high)


def first_events(log: DataFrame, type_: str) -> DataFrame:
    """Events that open their stream and have this type: what a reaction to new streams handles."""
    return log.where((F.col("position") == 0) & (F.col("type") == type_))


@F.pandas_udf(T.StructType([T.StructField("encoding", T.IntegerType()), T.StructField("body", T.BinaryType())]))
def compressed(data: pd.Series) -> pd.DataFrame:
    """Deflated where the body is over 48 bytes and that makes it smaller; a null body stays null."""

    def one(text):
        if text is None:
            return RAW, None
        raw = text.encode()
        if len(raw) > 48:
            packer = zlib.compressobj(6, zlib.DEFLATED, -15)
            small = packer.compress(raw) + packer.flush()
            if len(small) < len(raw):
                return DEFLATE, small
        return RAW, raw

    return pd.DataFrame([one(x) for x in data], columns=["encoding", "body"])


@F.pandas_udf(T.StringType())
def decompressed(encoding: pd.Series, body: pd.Series) -> pd.Series:
    """Text of raw and deflated bodies; an unknown encoding passes through. Brotli needs a module of that name."""

    def one(kind, data):
        if data is None or not len(data):
            return None
        if kind == DEFLATE:
            data = zlib.decompress(data, -15)
        elif kind == BROTLI:
            import brotli

            data = brotli.decompress(data)
        return bytes(data).decode()

    return pd.Series([one(k, b) for k, b in zip(encoding, body, strict=True)], dtype=object)
