"""Column functions over stream names, ids, checkpoints and sizes."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Version of the log format.
STORE_VERSION = "1.3.0"
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
OFFSETS = 1_000_000


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def category(name) -> Column:
    """Text before the first dash; the whole name where there is none."""
    return F.split_part(col(name), F.lit("-"), F.lit(1))


def stream_id(name) -> Column:
    """Text after the first dash; null where there is none."""
    name = col(name)
    at = F.instr(name, "-")
    return F.when(at > 0, F.substring(name, at + 1, F.length(name)))


def is_category(name) -> Column:
    return F.instr(col(name), "-") == 0


def cardinal_id(name) -> Column:
    """The id up to its first plus."""
    return F.split_part(stream_id(name), F.lit("+"), F.lit(1))


def hash_64(value) -> Column:
    """The first 64 bits of the md5 digest as a signed number."""
    digits = F.conv(F.substring(F.md5(col(value)), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(digits >= F.lit(Decimal(2**63)), digits - F.lit(Decimal(2**64))).otherwise(digits).cast("long")


def group_member(name, size: int) -> Column:
    """The consumer of a group of `size` that a stream belongs to; null for a name without an id."""
    h = hash_64(cardinal_id(name)).cast("decimal(20,0)")  # abs of the least long has no long
    return (F.abs(h) % size).cast("int")


def compose(category_name, *ids) -> Column:
    """category-id, ids joined by underscores. Raises for an empty or dashed category and for bad elements."""
    c = col(category_name)
    bad = (F.length(c) == 0) | (F.instr(c, "-") > 0)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad category: "), c))).otherwise(c)
    return F.concat(checked, F.lit("-"), compose_id(*ids))


def compose_id(*ids) -> Column:
    parts = [F.when((F.length(col(i)) == 0) | (F.instr(col(i), "_") > 0), F.raise_error(F.concat(F.lit("bad id element: "), col(i)))).otherwise(col(i)) for i in ids]
    return F.concat_ws("_", *parts)


def split_name(name) -> Column:
    """struct<category, id>; raises unless both parts are non-empty."""
    n = col(name)
    c, i = category(n), stream_id(n)
    bad = i.isNull() | (F.length(c) == 0) | (F.length(i) == 0)
    c = F.when(bad, F.raise_error(F.concat(F.lit("bad stream name: "), n))).otherwise(c)
    return F.struct(c.alias("category"), i.alias("id"))


def id_elements(stream_id_, count: int) -> Column:
    """The id's elements as an array; raises unless there are `count`, none empty."""
    i = col(stream_id_)
    parts = F.split(i, "_")
    bad = (F.size(parts) != count) | F.exists(parts, lambda p: F.length(p) == 0)
    return F.when(bad, F.raise_error(F.concat(F.lit("bad stream id: "), i))).otherwise(parts)


def try_match(name, category_name: str) -> Column:
    """The id of names of one category, else null."""
    return F.when(category(name) == category_name, stream_id(name))


def parse_uuid(value) -> Column:
    low = F.lower(col(value))
    return F.when(low.rlike(UUID), low).otherwise(F.raise_error(F.concat(F.lit("no uuid: "), low)))


def json_text(body, *path: str) -> Column:
    """A member as text, null where it is missing. Names with a dollar sign are quoted."""
    return F.get_json_object(col(body), "$" + "".join(f"['{p}']" if re.search(r"\W", p) else f".{p}" for p in path))


def day_text(time) -> Column:
    return F.to_date(col(time)).cast("string")


def checkpoint(epoch, offset) -> Column:
    return (col(epoch) * OFFSETS + col(offset)).cast("long")


def checkpoint_parts(value) -> Column:
    v = col(value)
    return F.struct(F.floor(v / OFFSETS).cast("long").alias("epoch"), (v % OFFSETS).cast("long").alias("offset"))


def after_epoch(epoch, version, closed) -> Column:
    """Where to go on: the next epoch's start after a closed one, else this one's version."""
    return F.when(col(closed), checkpoint(col(epoch) + 1, F.lit(0))).otherwise(checkpoint(epoch, version))


def snapshot_stream(name) -> Column:
    """category:snapshot-id of a stream name."""
    return F.concat(category(name), F.lit(":snapshot-"), stream_id(name))


def snapshot_version(metadata) -> Column:
    """Events that a snapshot covers: version, or the older streamVersion (a position) and one, or 0."""
    return F.coalesce(json_text(metadata, "version").cast("long"), json_text(metadata, "streamVersion").cast("long") + 1, F.lit(0).cast("long"))


def sha_id(value) -> Column:
    return F.sha2(col(value).cast("binary"), 256)


def size_of(*texts) -> Column:
    return sum((F.coalesce(F.length(col(t)), F.lit(0)) for t in texts), F.lit(0)).cast("long")


def event_bytes(type_="type", data="data", metadata="metadata") -> Column:
    """Stored size of an event in a log table."""
    return size_of(type_, data, metadata)


def document_event_bytes(type_, data, metadata, correlation, causation) -> Column:
    """Stored size of an event in a batch document, with its fixed part."""
    return size_of(type_, data, metadata, correlation, causation) + 40


def span_next(start, events) -> Column:
    return (col(start) + F.size(col(events))).cast("long")


def next_index(first, length, result, value=None) -> Column:
    """Next index of a stream after a handler's result: none, all, partial(value) or override(value)."""
    first, length, result = col(first), col(length), col(result)
    value = F.lit(None) if value is None else col(value)
    return (
        F.when(result == "none", first)
        .when(result == "partial", first + value)
        .when(result == "override", value)
        .otherwise(first + length)
        .cast("long")
    )


def correlation_metadata(own_id, parent_correlation=None, parent_id=None) -> Column:
    """JSON of correlation and causation: a root names itself, others keep the correlation and name their parent."""
    own = col(own_id)
    corr = own if parent_correlation is None else F.coalesce(col(parent_correlation), own)
    caus = own if parent_id is None else F.coalesce(col(parent_id), own)
    return F.to_json(F.struct(corr.alias("$correlationId"), caus.alias("$causationId")))


#: Reserved words, which an identifier quotes.
RESERVED = frozenset(
    """
    AES128 AES256 ALL ALLOWOVERWRITE ANALYSE ANALYZE AND ANY ARRAY AS ASC AUTHORIZATION BACKUP BETWEEN BINARY BLANKSASNULL
    BOTH BYTEDICT CASE CAST CHECK COLLATE COLUMN CONSTRAINT CREATE CREDENTIALS CROSS CURRENT_DATE CURRENT_TIME
    CURRENT_TIMESTAMP CURRENT_USER CURRENT_USER_ID DEFAULT DEFERRABLE DEFLATE DEFRAG DELTA DELTA32K DESC DISABLE DISTINCT DO
    ELSE EMPTYASNULL ENABLE ENCODE ENCRYPT ENCRYPTION END EXCEPT EXPLICIT FALSE FOR FOREIGN FREEZE FROM FULL GLOBALDICT256
    GLOBALDICT64K GRANT GROUP GZIP HAVING IDENTITY IGNORE ILIKE IN INITIALLY INNER INTERSECT INTO IS ISNULL JOIN LEADING
    LEFT LIKE LIMIT LOCALTIME LOCALTIMESTAMP LUN LUNS LZO LZOP MINUS MOSTLY13 MOSTLY32 MOSTLY8 NATURAL NEW NOT NOTNULL NULL
    NULLS OFF OFFLINE OFFSET OLD ON ONLY OPEN OR ORDER OUTER OVERLAPS PARALLEL PARTITION PERCENT PLACING PRIMARY RAW
    READRATIO RECOVER REFERENCES REJECTLOG RESORT RESTORE RIGHT SELECT SESSION_USER SIMILAR SOME SYSDATE SYSTEM TABLE TAG
    TDES TEXT255 TEXT32K THEN TO TOP TRAILING TRUE TRUNCATECOLUMNS UNION UNIQUE USER USING VERBOSE WALLET WHEN WHERE WITH
    WITHOUT
    """.lower().split()
)


def quote_identifier(name: str) -> str:
    plain = re.fullmatch(r"[a-z_][a-z0-9_$]*", name) and name not in RESERVED
    return name if plain else '"' + name.replace('"', '""') + '"'
