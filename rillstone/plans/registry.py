"""Every named query and its DuckDB equivalent. Each query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import codec, epochs, folds, projection, scans, snapshots, spans, views
from ..sources import logs
from ..sources.shared import shared_path
from ..sources.tables import read

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

USER = """log as (
  select event_id + 1 as global_position, 'User-' || user_id as stream_name, 'User' as category,
    row_number() over (partition by user_id order by event_id) - 1 as position, event_type as type, props as metadata, ts as time, value
  from events
)"""
CONV = """conv as (
  select 'Conversation-' || conv_id as stream_name, turn as position, role as type, text as data from conversations
)"""
INVOICE = """ev as (
  select o_orderkey as key, 'InvoiceRaised' as type, o_totalprice::decimal(18,2) as amount, o_custkey as payer, null as reference, 0 as phase,
    null::int as l1, null::bigint as l2, null::bigint as l3, null::double as l4 from orders
  union all
  select l_orderkey, 'PaymentReceived', l_extendedprice::decimal(18,2), null, l_partkey || ':' || l_suppkey, 1, l_linenumber, l_partkey, l_suppkey, l_quantity from lineitem
  union all
  select o_orderkey, 'InvoiceFinalized', null, null, null, 2, null, null, null, null from orders where o_orderstatus = 'F'
), log as (
  select 'Invoice-' || key as stream_name, type, amount, payer, reference,
    row_number() over (partition by key order by phase, l1 nulls first, l2 nulls first, l3 nulls first, amount nulls first, l4 nulls first) - 1 as position from ev
)"""
CORR = USER + """, corr as (
  select *, substr(stream_name, 6) || '_' || (position // 5) as session,
    case when position % 5 = 0 then global_position else lag(global_position) over (partition by stream_name order by position) end as cause
  from log
)"""
HASH = "('0x' || substr(md5({0}), 1, 16))::ubigint"
SIGNED = "(case when {h} >= 9223372036854775808 then {h}::hugeint - 18446744073709551616 else {h}::hugeint end)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def user(spark, d) -> DataFrame:
    return logs.user_log(spark, d)


# Summary views and explorer queries


def summary_sql(*keys: str) -> str:
    k = ", ".join(keys)
    return f"with {USER} select {k}, count(*) as message_count, round(count(*)::double / (select count(*) from log) * 100, 2) as percent from log group by {k}"


@query(summary_sql("category", "type"))
def category_type_summary(spark, d):
    return views.category_type_summary(user(spark, d))


@query(summary_sql("stream_name"))
def stream_summary(spark, d):
    return views.stream_summary(user(spark, d))


@query(summary_sql("stream_name", "type"))
def stream_type_summary(spark, d):
    return views.stream_type_summary(user(spark, d))


@query(summary_sql("type", "category"))
def type_category_summary(spark, d):
    return views.type_category_summary(user(spark, d))


@query(summary_sql("type", "stream_name"))
def type_stream_summary(spark, d):
    return views.type_stream_summary(user(spark, d))


@query(summary_sql("type"))
def type_summary(spark, d):
    return views.type_summary(user(spark, d))


@query("""with c as (select 'User' as category from events union all select 'Conversation' from conversations union all select 'Invoice' from orders)
select category, count(*) as count from c group by category""")
def events_by_category(spark, d):
    both = user(spark, d).select("category").union(logs.conv_log(spark, d).select("category"))
    return views.events_by_category(both.union(read(spark, d, "orders").select(F.lit("Invoice").alias("category"))))


@query(f"""with {USER}, p as (select max(time)::date as last from log)
select time::date::varchar as day, count(*) as count from log, p where time between last - interval 7 day and last + interval 1 day - interval 1 microsecond group by 1""")
def events_by_day(spark, d):
    log = user(spark, d)
    # the last day is one row that is broadcast; nothing is asked of the log while the query is made
    last = read(spark, d, "events").agg(F.max(F.to_date("ts")).alias("last"))
    low, high = F.date_sub("last", 7), F.col("last").cast("timestamp_ntz") + F.expr("interval '1' day - interval '0.000001' second")
    return views.events_by_day(log.crossJoin(F.broadcast(last)), low, high, "User")


@query(f"with {USER} select global_position, stream_name, type, time from log order by global_position desc limit 20")
def recent_streams(spark, d):
    return views.recent_streams(user(spark, d))


@query(f"with {USER} select stream_name, max(global_position) as global_position from log group by 1 order by 2 desc limit 20")
def recent_distinct_streams(spark, d):
    return views.recent_distinct_streams(user(spark, d))


@query(f"""with recursive {CORR}, tree(id, root, level) as (
  select global_position, global_position, 0::bigint from corr where cause = global_position
  union all select c.global_position, t.root, t.level + 1 from corr c join tree t on c.cause = t.id where c.global_position <> c.cause)
select * from tree""")
def causation_tree(spark, d):
    log = logs.correlated_log(spark, d)
    edges = log.select(F.col("global_position").alias("id"), N.json_text("metadata", "$causationId").cast("long").alias("cause"))
    return views.causation_tree(edges)


@query(f"""with {CONV} select stream_name, max(position) + 1 as version, sum(length(type) + length(data))::bigint as bytes from conv group by 1""")
def version_and_bytes(spark, d):
    return views.version_and_bytes(logs.conv_log(spark, d))


@query(f"""with {USER}, f as (select stream_name, type, min(position) as p from log group by 1, 2)
select stream_name, string_agg(type, ',' order by p) as types from f group by 1""")
def append_types(spark, d):
    return views.append_types(user(spark, d))


@query(f"""with {USER} select category, count(*) as events, ceil(count(*) / 500.0)::bigint as pages, 1::bigint as empty_pages, max(global_position) + 1 as tail from log group by 1""")
def feed_statistics(spark, d):
    return views.feed_statistics(user(spark, d), 500)


# Scans


@query(f"with {USER} select position, type, value from log where stream_name = 'User-7' and position >= 3 order by position limit 1000")
def stream_scan(spark, d):
    return scans.stream_messages(user(spark, d), "User-7", 3).select("position", "type", "value")


@query(f"with {USER} select position, type, value from log where stream_name = 'User-7' and position >= 0 and (type = 'click')")
def stream_scan_condition(spark, d):
    found = scans.stream_messages(user(spark, d), "User-7", None, -1, "type = 'click'", allow_condition=True)
    return found.select("position", "type", "value")


@query(f"with {USER} select position, (row_number() over (order by position) - 1) // 10 as batch from log where stream_name = 'User-7' and position >= 5")
def stream_pages(spark, d):
    return scans.pages(user(spark, d), "User-7", 5, 10).select("position", "batch")


@query(f"with {USER} select stream_name, count(*) as events, count(*) // 10 + 1 as n_batches from log group by 1")
def batches_read(spark, d):
    return scans.batches_read(user(spark, d), 10)


@query(f"with {USER} select stream_name, max(global_position) as global_position, max(position) as position, arg_max(type, position) as type from log group by 1")
def last_event(spark, d):
    return scans.last_messages(user(spark, d))


@query(f"with {USER} select stream_name, max(global_position) as global_position, max(position) as position, 'purchase' as type from log where type = 'purchase' group by 1")
def last_event_of_type(spark, d):
    return scans.last_messages(user(spark, d), "purchase")


@query(f"with {USER} select position, type from log where stream_name = 'User-3' order by position desc limit 1")
def stream_last_event(spark, d):
    return scans.last_message(user(spark, d), "User-3").select("position", "type")


@query(f"with {USER} select global_position, stream_name, position, type from log where global_position >= 100 order by global_position limit 500")
def category_scan_page(spark, d):
    return scans.category_messages(user(spark, d), "User", 100, 500).select("global_position", "stream_name", "position", "type")


@query(f"with {USER}, h as (select *, {HASH.format('split_part(substr(stream_name, 6), chr(43), 1)')} as u from log) select global_position, stream_name from h where abs({SIGNED.format(h='u')}) % 3 = 1")
def category_scan_member(spark, d):
    return scans.category_messages(user(spark, d), "User", None, -1, member=1, size=3).select("global_position", "stream_name")


@query(f"with {USER}, s as (select distinct stream_name, {HASH.format('substr(stream_name, 6)')} as u from log) select stream_name, (abs({SIGNED.format(h='u')}) % 4)::int as member from s")
def consumer_group_member(spark, d):
    return user(spark, d).select("stream_name").distinct().select("stream_name", N.group_member("stream_name", 4).alias("member"))


@query(f"with {CORR} select global_position, stream_name from corr where position % 2 = 0")
def category_scan_correlation(spark, d):
    return scans.category_messages(logs.correlated_log(spark, d), "User", 1, -1, correlation="Session").select("global_position", "stream_name")


@query(f"with {USER}, i as (select * from log where global_position >= 400 order by global_position limit 500) select count(*) as items, max(global_position) + 1 as checkpoint, false as is_tail from i")
def category_batch(spark, d):
    return scans.category_batch(user(spark, d), "User", 400, 500)


@query(f"with {CORR} select global_position as index, stream_name, type from corr where session = '7_0' and global_position > 0")
def correlated_events(spark, d):
    return scans.correlated(logs.correlated_log(spark, d), "7_0").select("index", "stream_name", "type")


@query(f"with {USER} select stream_name, max(position) as last_position, max(position) + 1 as version from log group by 1")
def stream_version(spark, d):
    return scans.stream_versions(user(spark, d))


@query(f"with {USER}, o as (select *, coalesce(max(case when type = 'signup' then position end) over (partition by stream_name), 0) as origin from log) select stream_name, position, type, origin from o where position >= origin")
def backward_origin_scan(spark, d):
    return scans.from_origin(user(spark, d), F.col("type") == "signup").select("stream_name", "position", "type", "origin")


@query(f"""with {USER}, u as (select stream_name, position, type, false as is_unfold from log union all select stream_name, max(position), 'Snapshotted', true from log group by 1),
o as (select *, max(case when is_unfold then position end) over (partition by stream_name) as origin from u) select stream_name, position, type, is_unfold from o where position >= origin""")
def tip_scan(spark, d):
    log = user(spark, d)
    tips = log.groupBy("stream_name").agg(F.max("position").alias("position")).withColumn("type", F.lit("Snapshotted")).withColumn("is_unfold", F.lit(True))
    both = log.select("stream_name", "position", "type", "is_unfold").unionByName(tips)
    return scans.from_origin(both, F.col("is_unfold")).select("stream_name", "position", "type", "is_unfold").orderBy("stream_name", "position", "is_unfold")


@query(f"with {USER} select stream_name, position, type from log")
def archive_stitch(spark, d):
    log = user(spark, d).select("stream_name", "position", "type")
    return scans.stitched(log.where("position < 20"), log.where("position between 15 and 40"), log.where("position > 35"))


@query(f"with {USER} select stream_name, min(position) as first from log where position >= 15 group by 1")
def missing_origin(spark, d):
    return scans.missing_origin(user(spark, d).where("position >= 15"))


@query(f"with {USER} select position, type from log where stream_name = 'User-5' and position between 4 and 30 order by position desc limit 12")
def range_read(spark, d):
    return scans.range_read(user(spark, d), "User-5", 4, 30, 12, backwards=True).select("position", "type")


BATCHES = f"{USER}, b as (select stream_name, position // 10 as b, min(position) as i, max(position) + 1 as n, string_agg(type, ',' order by position) as c from log group by 1, 2)"


@query(f"with {BATCHES} select stream_name, i, n, c from b where n > 5 and i < 40")
def batch_range(spark, d):
    found = scans.batch_range(scans.as_batches(user(spark, d), 10), 5, 40)
    return found.select("stream_name", "i", "n", F.array_join("c", ",").alias("c"))


@query(f"""with {USER}, k as (select stream_name, max(position) + 1 as n from log group by 1),
q as (select stream_name, n, substr(stream_name, 6)::int % 2 = 0 as same from k)
select stream_name, case when same then 'NotModified' else 'Found' end as outcome, case when not same then n end as index, case when not same then md5(stream_name || ':' || n) end as etag from q
union all select 'User-none', 'NotFound', null, null""")
def tip_read(spark, d):
    batches = scans.as_batches(user(spark, d), 10)
    known = batches.where("is_tip").select("stream_name", F.when(F.substring("stream_name", 6, 20).cast("int") % 2 == 0, F.col("etag")).otherwise("old").alias("etag"))
    none = known.limit(1).select(F.lit("User-none").alias("stream_name"), F.lit("x").alias("etag"))
    return scans.tip_read(batches, known.unionByName(none))


@query(f"with {USER} select stream_name, position, type from log")
def batch_unpack(spark, d):
    return scans.unpacked(scans.as_batches(user(spark, d), 10)).select("stream_name", "position", "type")


@query(f"""with {USER}, w as (select distinct stream_name, position // 20 as ordinal from log), f as (select stream_name, position // 20 as ordinal, position from log)
select w.ordinal as delivery, w.stream_name, f.position from w join f using (stream_name) where w.ordinal >= 1 and f.ordinal <= w.ordinal""")
def volatile_replay(spark, d):
    writes = user(spark, d).select(F.expr("position div 20").alias("ordinal"), "stream_name", "position")
    return scans.replay(writes, 1).select("delivery", "stream_name", "position")


@query(f"with {BATCHES} select stream_name, i, n from b where i % 20 <> 0")
def batch_prune(spark, d):
    batches = scans.as_batches(user(spark, d), 10)
    return scans.pruned(batches, batches.where("i % 20 = 0")).select("stream_name", "i", "n")


@query(f"with {USER}, m as (select max(time) as t from log) select stream_name, count(*) as events, (epoch_us((select t from m)) - epoch_us(max(time))) // 1000 as lead_ms from log group by 1")
def lead_times(spark, d):
    return scans.lead_times(user(spark, d))


@query(f"with {USER} select position, type from log where stream_name = 'User-2'")
def stream_dump(spark, d):
    lines = scans.dumped(user(spark, d), "User-2")
    return lines.select(N.json_text("line", "position").cast("long").alias("position"), N.json_text("line", "type").alias("type"))


# Functions


@query(f"""with {USER}, s as (select distinct stream_name from log) select stream_name, split_part(stream_name, '-', 1) as category, substr(stream_name, 6) as id,
  false as is_category, substr(stream_name, 6) as cardinal_id, 'User:snapshot-' || substr(stream_name, 6) as snapshot_stream, sha256(stream_name) as sha_id from s""")
def name_parts(spark, d):
    s = user(spark, d).select("stream_name").distinct()
    return s.select(
        "stream_name", N.category("stream_name").alias("category"), N.stream_id("stream_name").alias("id"), N.is_category("stream_name").alias("is_category"),
        N.cardinal_id("stream_name").alias("cardinal_id"), N.snapshot_stream("stream_name").alias("snapshot_stream"), N.sha_id("stream_name").alias("sha_id"),
    )


@query(f"select c_custkey, {SIGNED.format(h='u')}::bigint as hash from (select c_custkey, {HASH.format('c_name')} as u from customer)")
def hash_64(spark, d):
    return read(spark, d, "customer").select("c_custkey", N.hash_64("c_name").alias("hash"))


@query("select p_partkey, 'Part-' || p_size || '_' || p_partkey as name, p_size::varchar as first, p_partkey::varchar as second from part")
def stream_id_elements(spark, d):
    p = read(spark, d, "part").withColumn("name", N.compose(F.lit("Part"), F.col("p_size").cast("string"), F.col("p_partkey").cast("string")))
    parts = N.id_elements(N.split_name("name")["id"], 2)
    return p.select("p_partkey", "name", parts[0].alias("first"), parts[1].alias("second"))


@query(f"with {USER} select global_position, (position * 1000000 + global_position % 1000000)::bigint as checkpoint, position::bigint as epoch, (global_position % 1000000)::bigint as at_offset, case when position % 2 = 0 then (position + 1) * 1000000 else position * 1000000 + 7 end::bigint as next from log")
def checkpoint_codec(spark, d):
    log = user(spark, d).withColumn("cp", N.checkpoint("position", F.col("global_position") % 1_000_000))
    parts = N.checkpoint_parts("cp")
    after = N.after_epoch("position", F.lit(7), F.col("position") % 2 == 0)
    return log.select("global_position", F.col("cp").alias("checkpoint"), parts["epoch"].alias("epoch"), parts["offset"].alias("at_offset"), after.alias("next"))


@query("select conv_id, turn, (length(role) + length(text))::bigint as bytes, (length(role) + length(text) + 40)::bigint as document_bytes from conversations")
def event_bytes(spark, d):
    c = logs.conv_log(spark, d).withColumn("none", F.lit(None).cast("string"))
    size = N.document_event_bytes("type", "data", "metadata", "none", "none")
    return c.select(N.stream_id("stream_name").cast("long").alias("conv_id"), F.col("position").alias("turn"), N.event_bytes().alias("bytes"), size.alias("document_bytes"))


@query("select o_orderkey, lower(u) as uuid from (select o_orderkey, upper(substr(h,1,8)||'-'||substr(h,9,4)||'-'||substr(h,13,4)||'-'||substr(h,17,4)||'-'||substr(h,21,12)) as u from (select o_orderkey, md5(o_orderkey::varchar) as h from orders))")
def uuid_parse(spark, d):
    h = F.md5(F.col("o_orderkey").cast("string"))
    u = F.upper(F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    return read(spark, d, "orders").select("o_orderkey", N.parse_uuid(u).alias("uuid"))


@query(f"with {CORR} select global_position, session as correlation, cause::varchar as causation from corr")
def correlation_metadata(spark, d):
    log = logs.correlated_log(spark, d)
    made = N.correlation_metadata(F.col("global_position").cast("string"), N.json_text("metadata", "$correlationId"), N.json_text("metadata", "$causationId"))
    out = log.select("global_position", made.alias("m"))
    return out.select("global_position", N.json_text("m", "$correlationId").alias("correlation"), N.json_text("m", "$causationId").alias("causation"))


@query("""select event_id, case event_type when 'click' then 5 when 'view' then 5 + 3 when 'purchase' then 5 + 1 else 2 end::bigint as next from events""")
def stream_results(spark, d):
    e = read(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "none").when(F.col("event_type") == "view", "all").when(F.col("event_type") == "purchase", "partial").otherwise("override")
    value = F.when(F.col("event_type") == "purchase", 1).otherwise(2)
    return e.select("event_id", N.next_index(F.lit(5), F.lit(3), kind, value).alias("next"))


# Codecs


@query(f"with {USER} select global_position, type, value from log where type in ('click', 'purchase')")
def codec_decode(spark, d):
    out = codec.decode(user(spark, d), {"click": "value double", "purchase": "value double"})
    return out.select("global_position", "type", F.coalesce("click.value", "purchase.value").alias("value"))


@query(f"with {USER} select global_position, case type when 'purchase' then value * 2 else value end as body from log where type in ('purchase', 'view') and position % 2 = 0")
def upcast_keep(spark, d):
    v = N.json_text("data", "value").cast("double")
    out = codec.upcast(user(spark, d), {"purchase": v * 2, "view": v})
    return codec.keep(out, F.col("position") % 2 == 0).select("global_position", "body")


@query(f"with {USER} select global_position from log where type in ('signup', 'error') and position between 2 and 9")
def keep_types_range(spark, d):
    return codec.index_range(codec.keep_types(user(spark, d), ["signup", "error"]), 2, 9).select("global_position")


@query(f"with {USER} select global_position, substr(stream_name, 6) as stream_id from log")
def stream_match(spark, d):
    both = user(spark, d).select("stream_name", "global_position").union(logs.conv_log(spark, d).select("stream_name", "global_position"))
    return codec.match_category(both, "User").select("global_position", "stream_id")


@query("select count(*) as n from (select 1 from events union all select 1 from conversations)")
def category_prefixes(spark, d):
    every = user(spark, d).select("stream_name").union(logs.conv_log(spark, d).select("stream_name")).union(logs.invoice_log(spark, d).select("stream_name"))
    return codec.match_categories(every, ["User", "Conversation"]).agg(F.count("*").alias("n"))


@query("select 'Invoice-' || o_orderkey as stream_name, o_totalprice::decimal(18,2)::double as amount from orders")
def handler_first_event(spark, d):
    return codec.first_events(logs.invoice_log(spark, d), "InvoiceRaised").select("stream_name", F.col("amount").cast("double").alias("amount"))


@query("select conv_id, turn, text, length(text) > 60 as over from conversations")
def compressed_bodies(spark, d):
    c = read(spark, d, "conversations").withColumn("x", codec.compressed("text"))
    return c.select("conv_id", "turn", codec.decompressed("x.encoding", "x.body").alias("text"), (F.length("text") > 60).alias("over"))


@query(f"with {USER}, a as (select stream_name, list(value order by position desc) filter (where value >= 50) as v from log group by 1) select stream_name, coalesce(list_sum(list_transform(v, lambda x: round(x)::bigint)), 0)::bigint as total, coalesce(round(v[1])::bigint, -1) as newest from a")
def keep_map_reversed(spark, d):
    a = user(spark, d).groupBy("stream_name").agg(F.array_sort(F.collect_list(F.struct("position", "value"))).alias("v"))
    kept = codec.keep_map(F.col("v"), lambda x: F.when(x["value"] >= 50, F.round(x["value"]).cast("long")), backwards=True)
    return a.select("stream_name", kept.alias("k")).select(
        "stream_name", F.aggregate("k", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.coalesce(F.try_element_at("k", F.lit(1)), F.lit(-1).cast("long")).alias("newest")
    )


# Folds


@query(f"with {USER} select stream_name, round(sum(value::decimal(18,4))::double, 4) as total, count(*) as version from log group by 1")
def counter_fold(spark, d):
    log = user(spark, d).withColumn("amount", F.col("value").cast("decimal(18,4)"))
    return folds.counter(log, "amount").withColumn("total", F.round(F.col("total").cast("double"), 4))


@query(f"with {USER}, l as (select stream_name, arg_max(type, position) as t, arg_max(value, position) as v from log group by 1) select stream_name, case when t = 'error' then null else v end as value from l")
def latest_known_event_state(spark, d):
    return folds.latest(user(spark, d), "value", deleted="error")


@query(f"""with {INVOICE}, m as (select *, type = 'PaymentReceived' and row_number() over (partition by stream_name, reference order by position) > 1 as repeat from log),
p as (select stream_name, sum(amount) filter (where type = 'InvoiceRaised') as amount, max(payer) as payer,
  sum(amount) filter (where type = 'PaymentReceived' and not repeat) as paid, count(*) filter (where type = 'PaymentReceived' and not repeat) as refs,
  count(*) filter (where type = 'InvoiceRaised') as raises, min(position) filter (where type = 'InvoiceRaised') as raised_at,
  min(position) filter (where type = 'InvoiceFinalized') as final_at, max(position) as last from m group by 1)
select stream_name, case when raised_at is null then 'initial' when final_at is not null then 'finalized' else 'raised' end as status, amount::double as amount, payer,
  coalesce(paid, 0)::double as amount_paid, refs as "references", (coalesce(raised_at, last + 1) + greatest(raises - 1, 0) + coalesce(last - final_at, 0))::bigint as illegal from p""")
def invoice_fold(spark, d):
    return folds.invoice(logs.invoice_log(spark, d))


@query(f"""with {USER}, c as (select stream_name, type, round(value * 100)::bigint as cents from log),
p as (select stream_name, coalesce(sum(cents) filter (where type = 'purchase'), 0)::bigint as charges, coalesce(sum(cents) filter (where type = 'view'), 0)::bigint as payments, bool_or(type = 'signup') as closed from c group by 1)
select stream_name, charges - payments as balance, charges, payments, case when closed then 'closed' else 'active' end as state from p""")
def guest_stay_balance(spark, d):
    return folds.guest_stay(user(spark, d))


def stays_of(spark, d):
    stay = folds.guest_stay(user(spark, d))
    number = N.stream_id("stream_name").cast("long")
    return stay.select((number % 10).alias("group"), "stream_name", F.col("balance").alias("residual"), (F.col("state") == "active").alias("ok"))


@query(f"""with {USER}, c as (select stream_name, type, round(value * 100)::bigint as cents from log),
p as (select stream_name, coalesce(sum(cents) filter (where type = 'purchase'), 0)::bigint - coalesce(sum(cents) filter (where type = 'view'), 0)::bigint as balance, not bool_or(type = 'signup') as ok from c group by 1),
g as (select substr(stream_name, 6)::bigint % 10 as "group", count(*) as stays, sum(ok::int)::bigint as merged, sum((not ok)::int)::bigint as failed, coalesce(sum(balance) filter (where ok), 0)::bigint as balance from p group by 1),
b as (select "group", stays, merged, failed, balance - 100 * "group" as balance from g)
select *, case when failed > 0 then 'wait' when balance = 0 then 'confirm' else 'pay' end as next_action from b""")
def group_checkout_residual(spark, d):
    payments = spark.range(10).select(F.col("id").alias("group"), (F.col("id") * 100).alias("paid"))
    return folds.group_checkout(stays_of(spark, d), payments)


@query(f"with {USER} select stream_name, position, type <> 'error' as decodable, (sum(case when type = 'error' then 0 else round(value * 100)::bigint end) over (partition by stream_name order by position))::bigint as state from log")
def state_timeline_balance(spark, d):
    out = folds.timeline(user(spark, d), F.round(F.col("value") * 100).cast("long"), F.col("type") != "error")
    return out.select("stream_name", "position", "decodable", "state")


@query(f"""with {USER}, p as (select stream_name, arg_max(time, position) filter (where type = 'view') as b, arg_max(time, position) filter (where type = 'purchase') as e, max(position) + 1 as version from log group by 1)
select stream_name, case when e is not null then 'ended' when b is not null then 'begun' else 'pending' end as status, (epoch_us(e) - epoch_us(b)) // 1000 as duration_ms, version from p""")
def appointment_actuals(spark, d):
    out = folds.appointments(user(spark, d), "view", "purchase")
    return out


CART = f"""{USER}, rows as (
  select stream_name, position, type, 'sku' || (global_position % 5) as sku, round(value)::bigint as quantity, value > 50 as waived, 'sku' || (position % 3) as kept from log
), walk(stream_name, position, items) as (
  select stream_name, -1::bigint, []::struct(sku varchar, quantity bigint, waived boolean)[] from (select distinct stream_name from log)
  union all
  select r.stream_name, r.position, case r.type
    when 'click' then list_prepend({{'sku': r.sku, 'quantity': r.quantity, 'waived': r.waived}}, w.items)
    when 'view' then list_prepend({{'sku': r.sku, 'quantity': r.quantity, 'waived': null::boolean}}, w.items)
    when 'purchase' then list_filter(w.items, lambda x: x.sku <> r.sku)
    when 'error' then list_transform(w.items, lambda x: case when x.sku = r.sku then {{'sku': x.sku, 'quantity': r.quantity % 3, 'waived': x.waived}} else x end)
    when 'signup' then case when r.position % 2 = 0 then [{{'sku': r.kept, 'quantity': r.position, 'waived': null::boolean}}]
      else list_transform(w.items, lambda x: case when x.sku = r.sku then {{'sku': x.sku, 'quantity': x.quantity, 'waived': r.waived}} else x end) end
    else w.items end
  from walk w join rows r on r.stream_name = w.stream_name and r.position = w.position + 1
), last as (
  select stream_name, arg_max(items, position) as items, max(position) + 1 as version from walk group by 1
)"""


@query(f"""with recursive {CART} select stream_name, len(items)::int as lines,
  array_to_string(list_transform(items, lambda x: x.sku || ':' || x.quantity || ':' || coalesce(x.waived::varchar, '-')), ',') as state, version from last""")
def cart_items(spark, d):
    log = user(spark, d)
    odd = F.col("position") % 2 == 1
    kinds = {"click": "ItemAdded", "view": "ItemAdded", "purchase": "ItemRemoved", "error": "ItemQuantityChanged", "signup": "Snapshotted"}
    type_ = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("type")]
    type_ = F.when((F.col("type") == "signup") & odd, "ItemPropertiesChanged").otherwise(type_)
    sku = F.concat(F.lit("sku"), (F.col("global_position") % 5).cast("string"))
    quantity = F.round("value").cast("long")
    kept = F.array(F.struct(F.concat(F.lit("sku"), (F.col("position") % 3).cast("string")).alias("sku"), F.col("position").alias("quantity"), F.lit(None).cast("boolean").alias("waived")))
    rows = log.select(
        "stream_name", "position", type_.alias("type"), sku.alias("sku"), F.when(F.col("type") == "error", quantity % 3).otherwise(quantity).alias("quantity"),
        F.when(F.col("type") != "view", F.col("value") > 50).alias("waived"), F.when((F.col("type") == "signup") & ~odd, kept).alias("items"),
    )
    out = folds.cart(rows)
    line = lambda x: F.concat_ws(":", x["sku"], x["quantity"].cast("string"), F.coalesce(x["waived"].cast("string"), F.lit("-")))
    return out.select("stream_name", F.size("state").alias("lines"), F.array_join(F.transform("state", line), ",").alias("state"), "version")


@query(f"""with recursive {USER}, walk(stream_name, position, state) as (
  select stream_name, -1::bigint, 0::bigint from (select distinct stream_name from log)
  union all select l.stream_name, l.position, case when l.type = 'click' and w.state < 10 then w.state + 1 when l.type = 'view' and w.state > 0 then w.state - 1 else w.state end
  from walk w join log l on l.stream_name = w.stream_name and l.position = w.position + 1)
select stream_name, arg_max(state, position) as state, max(position) + 1 as version from walk group by 1""")
def bounded_counter(spark, d):
    return folds.bounded_counter(user(spark, d), "click", "view")


@query(f"with {USER}, k as (select stream_name, position, type from log where position >= 30) select stream_name, position, type from k")
def position_assignment(spark, d):
    log = user(spark, d)
    base = log.where("position < 30").groupBy("stream_name").agg((F.max("position") + 1).alias("version"))
    later = log.where("position >= 30").select("stream_name", "type", "global_position")
    return folds.with_positions(later, base, "global_position").select("stream_name", "position", "type")


# Snapshots and joins


def snapshot_log(spark, d):
    log = user(spark, d).select("stream_name", "category", "position", "type", "data", "metadata", "value")
    states = log.where("position < 20").groupBy("stream_name").agg((F.max("position") + 1).alias("version"), F.sum(F.round(F.col("value") * 100).cast("long")).cast("string").alias("data"))
    snaps = snapshots.adjacent(log, states, 10).withColumn("position", F.lit(0).cast("long")).withColumn("value", F.lit(None).cast("double"))
    return log, snaps


@query(f"with {USER} select stream_name, count(*) as version, sum(round(value * 100)::bigint)::bigint as state from log where position < 20 group by 1 having count(*) >= 10")
def snapshot_read(spark, d):
    log, snaps = snapshot_log(spark, d)
    out = snapshots.read_adjacent(log.unionByName(snaps), "Snapshotted")
    return out.select("stream_name", "version", F.col("data").cast("long").alias("state"))


@query(f"with {USER} select stream_name, sum(round(value * 100)::bigint)::bigint as state from log group by 1")
def snapshot_state(spark, d):
    log, snaps = snapshot_log(spark, d)
    known = snapshots.read_adjacent(snaps).select("stream_name", "version", F.col("data").cast("long").alias("state"))
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    return snapshots.resumed(log, known, F.lit(0).cast("long"), cents, lambda s, t: s + t)


@query(f"with {USER}, n as (select stream_name, count(*) as c from log where position < 20 group by 1) select stream_name, count(*) as events from log join n using (stream_name) where position >= case when c >= 10 then c else 0 end group by 1")
def snapshot_tail_count(spark, d):
    log, snaps = snapshot_log(spark, d)
    return snapshots.events_since(log, snapshots.read_adjacent(snaps)).groupBy("stream_name").agg(F.count("*").alias("events"))


@query(f"with {USER}, s as (select stream_name, count(*) as state from log group by 1) select stream_name, case when state >= 60 then state + 1 else state end as state, case when state >= 60 then 'snapshot' else 'fold' end as source from s")
def snapshot_table_read(spark, d):
    full = user(spark, d).groupBy("stream_name").agg(F.count("*").alias("state"))
    stored = full.withColumn("usable", F.col("state") >= 60).withColumn("state", F.col("state") + 1)
    return snapshots.read_table(stored, full, F.col("usable"))


@query(f"with {USER}, s as (select stream_name, count(*) as n from log group by 1) select stream_name, case when n % 2 = 0 then n * 10 else n end as state from s")
def snapshot_upsert(spark, d):
    table = user(spark, d).groupBy("stream_name").agg(F.count("*").alias("state"))
    return snapshots.upserted(table, table.where("state % 2 = 0").withColumn("state", F.col("state") * 10))


@query(f"with {USER}, s as (select stream_name, count(*) as n from log group by 1) select stream_name, n % 3 = 0 as applied from s")
def rolling_state_swap(spark, d):
    table = user(spark, d).groupBy("stream_name").agg(F.count("*").alias("n")).withColumn("etag", F.md5(F.col("n").cast("string")))
    rows = table.select("stream_name", F.when(F.col("n") % 3 == 0, F.col("etag")).otherwise("old").alias("expected_etag"))
    return snapshots.swapped(table, rows).select("stream_name", "applied")


@query("select o_orderkey, c_name as payer, case when c_name is null then 'PayerMissing' else 'Emailed' end as outcome from orders left join customer on c_custkey = o_custkey and c_custkey % 10 <> 3")
def payer_lookup(spark, d):
    payers = read(spark, d, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("payer"))
    out = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(payers, "o_custkey", "left")
    return out.select("o_orderkey", "payer", F.when(F.col("payer").isNull(), "PayerMissing").otherwise("Emailed").alias("outcome"))


@query(f"""with {USER}, c as (select stream_name, type from log), p as (select stream_name, not bool_or(type = 'signup') as ok from c group by 1)
select substr(stream_name, 6)::bigint % 10 as "group", stream_name as stay, case when ok then 'merged' else 'failed' end as outcome from p""")
def checkout_fanout(spark, d):
    """A row for each stay of a group, joined with the stays' states and split by whether they can be merged."""
    stays = stays_of(spark, d)
    # a group's stays stay rows; gathered into an array, one group could fill a task
    groups = stays.select("group", F.col("stream_name").alias("stay")).distinct()
    joined = groups.join(stays.select(F.col("stream_name").alias("stay"), "ok"), "stay", "left")
    return joined.select("group", "stay", F.when(F.col("ok"), "merged").otherwise("failed").alias("outcome"))


@query(f"with {INVOICE}, s as (select distinct reference from log where type = 'PaymentReceived' and position <= 2) select distinct stream_name, reference from log where type = 'PaymentReceived' and position > 2 and reference not in (select reference from s)")
def unseen_payments(spark, d):
    paid = logs.invoice_log(spark, d).where("type = 'PaymentReceived'")
    seen = paid.where("position <= 2").select("reference").distinct()
    return paid.where("position > 2").join(seen, "reference", "left_anti").select("stream_name", "reference").distinct()


# Spans and epochs


@query(f"""with {USER}, g as (select stream_name, position, position - row_number() over (partition by stream_name order by position) as run from log where position % 7 <> 3 and position >= 2)
select stream_name, min(position) as start, count(*) as length from g group by stream_name, run""")
def span_islands(spark, d):
    return spans.islands(logs.gappy_log(spark, d), 2)


@query(f"with {USER} select stream_name, 0::bigint as start, count(*) as length from log group by 1")
def span_merge_redelivered(spark, d):
    return spans.islands(logs.redelivered_log(spark, d))


@query(f"""with {USER}, g as (select stream_name, position, lag(position, 1, -1) over (partition by stream_name order by position) + 1 as first_missing from log where position % 7 <> 3)
select stream_name, first_missing, position - first_missing as missing from g where position > first_missing""")
def gap_streams(spark, d):
    return spans.gaps(logs.gappy_log(spark, d))


@query(f"with {USER} select stream_name, position from log where position >= 12")
def drop_before_index(spark, d):
    return codec.index_range(user(spark, d), 12).select("stream_name", "position")


SPANS = f"{USER}, sp as (select stream_name, min(global_position) as ordinal, min(position) as i, string_agg(type, ',' order by position) as c, count(*) as n from log group by stream_name, position // 4)"


@query(f"with {USER} select stream_name, 0::bigint as start, string_agg(type, ',' order by position) as events from log group by 1")
def span_flatten(spark, d):
    log = user(spark, d)
    cut = spans.spans_of(log, 4).select("stream_name", "i", "c")
    again = spans.spans_of(log, 6).select("stream_name", "i", "c")
    out = spans.flatten(cut.unionByName(again))
    return out.select("stream_name", F.col("start").cast("long").alias("start"), F.array_join("events", ",").alias("events"))


@query(f"with {SPANS} select stream_name, max(i + n) as next_index from sp group by 1")
def high_water_marks(spark, d):
    return spans.high_water(spans.spans_of(user(spark, d), 4))


@query(f"""with {USER}, b as (select *, (global_position - 1) // 500 as batch from log), p as (select stream_name, max(position) + 1 as next_index from log where position % 3 = 0 group by 1),
r as (select batch, stream_name, max(position) + 1 as required_index from b group by 1, 2) select batch, stream_name, required_index from r left join p using (stream_name) where required_index > coalesce(next_index, 0)""")
def batch_requirements(spark, d):
    """What each batch of 500 global positions of the whole log still requires, given how far its streams have come."""
    log = user(spark, d).withColumn("batch", F.expr("(global_position - 1) div 500"))
    progress = log.where("position % 3 = 0").groupBy("stream_name").agg((F.max("position") + 1).alias("next_index"))
    return spans.still_required(log, progress, "batch")


@query(f"with {USER} select stream_name, position, type, value from log where (position // 4) % 2 = 0")
def span_hydration(spark, d):
    log = user(spark, d)
    return spans.hydrate(spans.spans_of(log, 4).where("(i div 4) % 2 = 0"), log.select("stream_name", "position", "type", "value"))


@query(f"with {USER} select stream_name, position, type, null::varchar as data from log")
def span_index_only(spark, d):
    return spans.index_only(spans.spans_of(user(spark, d), 4))


@query(f"with {USER} select stream_name, max(position) + 1 - least(count(*), 2) as i, string_agg(type, ',' order by position) filter (where rn <= 2) as c from (select *, row_number() over (partition by stream_name, position // 5 order by position desc) as rn from log) group by stream_name, position // 5")
def change_parse(spark, d):
    batches = scans.as_batches(user(spark, d), 5)
    records = batches.select(F.when(F.col("b") % 2 == 0, "INSERT").otherwise("MODIFY").alias("op"), "stream_name", "n", F.least(F.size("c"), F.lit(2)).alias("a"), "c")
    gone = records.limit(5).withColumn("op", F.lit("REMOVE"))
    system = records.limit(5).withColumn("stream_name", F.lit("$system-1"))
    out = spans.parse_changes(records.unionByName(gone).unionByName(system))
    return out.select("stream_name", "i", F.array_join("c", ",").alias("c"))


@query(f"""with {SPANS}, k as (select stream_name, count(*) * 2 // 3 as next_index from log where substr(stream_name, 6)::int % 4 <> 0 group by 1), j as (select sp.*, next_index from sp left join k using (stream_name))
select stream_name, i, case when next_index is null then 'start' when i > next_index then 'gap' when i + n > next_index then 'append' else 'discard' end as outcome,
  case when next_index is null or i >= next_index then n else greatest(i + n - next_index, 0) end::int as fresh from j""")
def epoch_classify(spark, d):
    log = user(spark, d)
    # two thirds of most streams are known already
    known = log.where("cast(substring(stream_name, 6) as int) % 4 <> 0").groupBy("stream_name").agg(F.expr("count(*) * 2 div 3").alias("next_index"))
    out = epochs.classify(spans.spans_of(log, 4).select("stream_name", "i", "c"), known)
    return out.select("stream_name", "i", "outcome", F.size("fresh").alias("fresh"))


EPOCHS = f"{SPANS}, ep as (select stream_name, i, c, n, (row_number() over (order by ordinal) - 1) as k from sp), ch as (select stream_name, i, c, n, k // 100 as epoch, k % 100 as ordinal from ep)"


def epoch_changes(spark, d):
    return epochs.assigned_epochs(spans.spans_of(user(spark, d), 4), 100)


@query(f"with {EPOCHS} select epoch, ordinal, stream_name, i, c from ch")
def epoch_ingest(spark, d):
    return epoch_changes(spark, d).select("epoch", "ordinal", "stream_name", "i", F.array_join("c", ",").alias("c"))


@query(f"with {EPOCHS} select ordinal, count(*)::int as spans from ch where epoch = 1 and ordinal >= 10 group by 1")
def epoch_read(spark, d):
    return epochs.read_epoch(epoch_changes(spark, d), 1, 10).select("ordinal", F.size("spans").alias("spans"))


@query(f"with {EPOCHS} select 0 as partition, max(epoch) as active_epoch from ch")
def epoch_heads(spark, d):
    return epochs.heads(epoch_changes(spark, d).withColumn("partition", F.lit(0)))


@query(f"""with {EPOCHS}, m as (select max(epoch) as last from ch), b as (select epoch, ordinal // 30 as batch, count(*) as spans, max(ordinal) + 1 as upto, max(max(ordinal)) over (partition by epoch) + 1 as version, max(ordinal // 30) over (partition by epoch) as lastb from ch group by epoch, ordinal // 30, ordinal)
select epoch, batch, sum(spans)::bigint as spans, case when batch = any_value(v) then case when epoch < (select last from m) then (epoch + 1) * 1000000 else epoch * 1000000 + any_value(ver) end else epoch * 1000000 + max(upto) end::bigint as checkpoint,
  batch = any_value(v) and epoch = (select last from m) as is_tail
from (select b.*, max(batch) over (partition by epoch) as v, max(upto) over (partition by epoch) as ver from b) group by epoch, batch""")
def epoch_crawl(spark, d):
    changes = epoch_changes(spark, d)
    per = changes.groupBy("epoch").agg((F.max("ordinal") + 1).alias("version"))
    last = F.max("epoch").over(Window.partitionBy(F.lit(0)))
    return epochs.crawl(changes, per.withColumn("closed", F.col("epoch") < last), 30)


@query(f"with {EPOCHS} select max(epoch * 1000000 + ordinal + 1)::bigint as position from ch")
def start_from_tail(spark, d):
    return epoch_changes(spark, d).agg(F.max(N.checkpoint("epoch", F.col("ordinal") + 1)).alias("position"))


# Projections


def changes_of(spark, d):
    log = user(spark, d)
    action = F.when(F.col("type") == "error", "Delete").otherwise("Upsert")
    data = F.create_map(F.lit("type"), F.col("type"), F.lit("cents"), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit("version"), F.col("position").cast("string"))
    data = F.when(F.col("type") == "error", F.create_map(F.lit("version"), F.col("position").cast("string"))).otherwise(data)
    return log.select("stream_name", F.col("position").alias("seq"), action.alias("action"), data.alias("data"))


LATEST = f"{USER}, l as (select stream_name, arg_max(type, position) as type, arg_max(round(value * 100)::bigint, position) as cents, max(position) as version from log group by 1)"


@query(f"with {LATEST} select stream_name, case when type = 'error' then 'Delete' else 'Upsert' end as action, version::varchar as version from l")
def change_collapse(spark, d):
    return projection.collapse(changes_of(spark, d), "stream_name").select("stream_name", "action", F.col("data")["version"].alias("version"))


@query(f"""with {LATEST}, old as (select stream_name, 'old' as type, 0::bigint as cents, case when version % 3 = 0 then version + 1 else 0 end as version from l)
select old.stream_name, case when l.version > old.version then l.type else old.type end as type, case when l.version > old.version then l.cents else old.cents end as cents, greatest(l.version, old.version) as version
from old join l using (stream_name) where not (l.type = 'error' and l.version > old.version)""")
def versioned_upsert(spark, d):
    changes = changes_of(spark, d)
    top = changes.groupBy("stream_name").agg(F.max("seq").alias("v"))
    old = top.select("stream_name", F.lit("old").alias("type"), F.lit(0).cast("long").alias("cents"), F.when(F.col("v") % 3 == 0, F.col("v") + 1).otherwise(0).cast("long").alias("version"))
    return projection.project(old, changes, ["stream_name"], "version")


# Reactions


@query(f"with {USER} select stream_name, position, type from log")
def reaction_at_least_once(spark, d):
    """Two deliveries of a log, the second with repeats, through the stateful reactor: each event is handled once."""
    from ..streaming import reactor

    at = shared_path(spark, "reaction")
    log = logs.redelivered_log(spark, d).select("stream_name", "position", "type", "data", "delivery")
    for n in (0, 1):
        log.where(F.col("delivery") == n).drop("delivery").write.parquet(f"{at}/in/{n}")
    events = spark.readStream.schema("stream_name string, position long, type string, data string").option("maxFilesPerTrigger", 8).parquet(f"{at}/in/*")
    reactor.run_once(events, reactor.take_all, f"{at}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/{n}"))
    return spark.read.schema(reactor.HANDLED).parquet(f"{at}/out/*")


# Operators that had no query of their own


@query(f"with {BATCHES} select stream_name, i, c, n from b where n > 5")
def projected_range(spark, d):
    found = scans.batch_range(scans.as_batches(user(spark, d), 10), 5, indexes_only=True)
    return found.select("stream_name", "i", F.array_join("c", ",").alias("c"), "n")


@query(f"with {BATCHES} select stream_name, i, n from b where n > 5 order by i desc, stream_name limit 40")
def batch_range_backwards(spark, d):
    return scans.batch_range(scans.as_batches(user(spark, d), 10), 5, backwards=True, limit=40).select("stream_name", "i", "n")


@query(f"with {USER} select stream_name, min(position) as first, count(*) as events from log where position >= 15 group by 1")
def load_ignoring_missing(spark, d):
    log = user(spark, d).select("stream_name", "position", "type").where("position >= 15")
    found = scans.loaded(log.where("position > 30"), log.where("position <= 35"), ignore_missing=True)
    return found.groupBy("stream_name").agg(F.min("position").alias("first"), F.count("*").alias("events"))


@query(f"with {USER} select stream_name, position, type from log")
def load_from_archive(spark, d):
    log = user(spark, d).select("stream_name", "position", "type")
    return scans.loaded(log.where("position > 35"), log.where("position between 15 and 40"), log.where("position < 20"))


@query("select '1.3.0' as version")
def store_version(spark, d):
    return spark.range(1).select(F.lit(N.STORE_VERSION).alias("version"))


@query("""select name, quoted from (values ('plain', 'plain'), ('select', '"select"'), ('Mixed', '"Mixed"'), ('two words', '"two words"'), ('a"b', '"a""b"'), ('_x1', '_x1'),
  ('sysdate', '"sysdate"'), ('1st', '"1st"'), ('user', '"user"'), ('users', 'users')) t(name, quoted)""")
def identifier_quoting(spark, d):
    names = ("plain", "select", "Mixed", "two words", 'a"b', "_x1", "sysdate", "1st", "user", "users")
    return spark.createDataFrame([(n, N.quote_identifier(n)) for n in names], "name string, quoted string")


@query(f"with {USER}, h as (select stream_name, min(position) filter (where position % 7 <> 3 and position >= stream % 5) as head, stream % 5 as write from (select *, substr(stream_name, 6)::bigint as stream from log) group by stream_name, stream) select stream_name, head <> write as gap from h")
def gap_predicate(spark, d):
    """Whether the first event at hand is not the one at the stream's write position."""
    log = user(spark, d).withColumn("write", N.stream_id("stream_name").cast("long") % 5)
    heads = log.where("position % 7 <> 3 and position >= write").groupBy("stream_name", "write").agg(F.min("position").alias("head"))
    return heads.select("stream_name", spans.gap_before("head", "write").alias("gap"))


MODEL = "old as (select c_custkey, c_name, c_acctbal::varchar as c_acctbal from customer where c_custkey % 3 <> 0)"


def read_model(spark, d) -> DataFrame:
    return read(spark, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"))


def renamed(spark, d, action: str) -> DataFrame:
    rows = read(spark, d, "customer").where("c_custkey % 2 = 0")
    return rows.select("c_custkey", F.lit(0).cast("long").alias("seq"), F.lit(action).alias("action"), F.create_map(F.lit("c_name"), F.concat(F.lit("new-"), F.col("c_name"))).alias("data"))


@query("select c_custkey, case when c_custkey % 3 = 0 then 'new-' || c_name else c_name end as c_name from customer where c_custkey % 3 <> 0 or c_custkey % 2 = 0")
def read_model_insert(spark, d):
    return projection.project(read_model(spark, d), renamed(spark, d, "Insert"), ["c_custkey"]).select("c_custkey", "c_name")


@query(f"with {MODEL} select c_custkey, case when c_custkey % 2 = 0 then 'new-' || c_name else c_name end as c_name from old")
def read_model_update(spark, d):
    return projection.project(read_model(spark, d), renamed(spark, d, "Update"), ["c_custkey"]).select("c_custkey", "c_name")


@query(f"with {MODEL} select c_custkey, c_name from old where c_custkey % 2 <> 0")
def read_model_delete(spark, d):
    gone = renamed(spark, d, "Delete").withColumn("data", F.create_map().cast("map<string,string>"))
    return projection.project(read_model(spark, d), gone, ["c_custkey"]).select("c_custkey", "c_name")


@query("select 'Conversation-' || conv_id as stream_name, (row_number() over (partition by conv_id order by turn) - 1) as position, role as type, text as data from conversations")
def append_events(spark, d):
    """Conversations appended to a stored log, their even turns first; positions are those that the appends give."""
    from ..sources.store import LogStore

    c = read(spark, d, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("half", F.row_number().over(order) > F.ceil(F.count("*").over(Window.partitionBy("conv_id")) / 2))
    rows = c.select(F.concat(F.lit("Conversation-"), F.col("conv_id").cast("string")).alias("stream_name"), F.col("turn").alias("n"), F.col("role").alias("type"), F.col("text").alias("data"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("id"), "half")
    store = LogStore(spark, shared_path(spark, "log"))
    for half in (False, True):
        store.append_frame(rows.where(F.col("half") == half).drop("half"))
    return store.log().select("stream_name", "position", "type", "data")


@query("select * from (values ('g', 'A', 7), ('g', 'B', 4), ('h', 'A', 0)) t(group_name, category, position)")
def checkpoint_store(spark, d):
    from ..sources.store import Checkpoints, LogStore

    points = Checkpoints(LogStore(spark, shared_path(spark, "log")))
    points.load("g", "A", 3)
    points.save("g", "A", 7)
    found = [("g", "A", points.load("g", "A", 9)), ("g", "B", points.load("g", "B", 4)), ("h", "A", points.load("h", "A"))]
    return spark.createDataFrame(found, "group_name string, category string, position int")


@query(f"with {USER} select stream_name, count(*) as version, count(*) filter (where type = 'click') as state from log where substr(stream_name, 6)::int < 5 group by 1")
def durable_decisions(spark, d):
    """Deciders over a stored log: one event for each row of five streams, counted by the fold that a later load gives."""
    from ..operators.decider import Category
    from ..sources.store import Event, LogStore

    store = LogStore(spark, shared_path(spark, "log"))
    rows = user(spark, d).where(N.stream_id("stream_name").cast("int") < 5)
    store.append_frame(rows.select("stream_name", F.col("position").alias("n"), "type", "data", "metadata", "id").where("n > 0"))
    category = Category(store, "User", lambda s, es: s + sum(e.type == "click" for e in es), 0)
    firsts = rows.where("position = 0").select("stream_name", "type").collect()  # five rows
    found = []
    for r in firsts:
        decider = category.decider(r.stream_name.removeprefix("User-"))
        version = decider.transact(lambda s, t=r.type: [Event(t)])
        found.append((r.stream_name, version, decider.query()))
    return spark.createDataFrame(found, "stream_name string, version long, state long")


@query(f"""with {USER}, t as (select stream_name, least(count(*), 6) as held, count(*) filter (where position >= 6) as fresh from log group by 1),
x as (select *, held + fresh > 10 as calve from t),
d as (select stream_name, 'tip' as kind, case when calve then held else 0 end as i, held + fresh as n, fresh as a from x where fresh > 0
  union all select stream_name, 'batch', 0, held, null from x where fresh > 0 and calve)
select d.*, (select string_agg(type, ',' order by position) from log where log.stream_name = d.stream_name and position >= i and position < n) as c from d""")
def document_append(spark, d):
    """Each stream's first six events are its tip, the others are appended at once; tips of more than ten events overflow."""
    from ..operators import documents

    log = user(spark, d)
    event = F.struct("position", "type", F.lit(None).cast("string").alias("data"))
    first = log.where("position < 6").groupBy("stream_name").agg((F.max("position") + 1).alias("n"), F.array_sort(F.collect_list(event)).alias("e"))
    tips = first.select("stream_name", "n", F.md5("stream_name").alias("etag"), "e", F.array().cast(f"array<{documents.UNFOLD}>").alias("u"), F.lit(0).cast("long").alias("b"))
    more = log.where("position >= 6").groupBy("stream_name").agg(F.array_sort(F.collect_list(event)).alias("events"))
    asked = more.select("stream_name", F.lit(6).cast("long").alias("expected_version"), F.lit(None).cast("string").alias("expected_etag"), "events", F.array().cast(f"array<{documents.UNFOLD}>").alias("unfolds"))
    out = documents.appended(tips, asked, 10, 1 << 30, 1 << 30)
    return out.select("stream_name", "kind", "i", "n", "a", F.array_join("c", ",").alias("c"))


@query(f"with {USER}, s as (select stream_name, count(*) as n from log group by 1) select stream_name, case when n % 3 = 0 then n * 10 else n end as state from s union all select 'User-new', 7")
def rolling_state_write(spark, d):
    table = user(spark, d).groupBy("stream_name").agg(F.count("*").alias("state")).withColumn("etag", F.md5(F.col("state").cast("string")))
    changed = table.select("stream_name", (F.col("state") * 10).alias("state"), F.lit("next").alias("etag"), F.when(F.col("state") % 3 == 0, F.col("etag")).otherwise("old").alias("expected_etag"))
    new = spark.createDataFrame([("User-new", 7, "next", None), ("User-other", 8, "next", "some")], "stream_name string, state long, etag string, expected_etag string")
    return snapshots.rolled(table, changed.unionByName(new)).select("stream_name", "state")


@query(f"with {USER} select stream_name, count(*) as events, max(position) as last from log group by 1")
def inline_projection(spark, d):
    """A read model that two appends keep, each in the manifest of its own."""
    from ..sources.store import LogStore

    store = LogStore(spark, shared_path(spark, "log"))

    def count(rows, read):
        own = rows.groupBy("stream_name").agg(F.count("*").alias("events"), F.max("position").alias("last"))
        old = read("counts")
        both = own if old is None else own.unionByName(old)
        return {"counts": both.groupBy("stream_name").agg(F.sum("events").alias("events"), F.max("last").alias("last"))}

    rows = user(spark, d).select("stream_name", F.col("position").alias("n"), "type", "data", "metadata", "id")
    for part in ("n % 2 = 0", "n % 2 = 1"):
        store.append_frame(rows.where(part), project=count)
    return store.read("counts")


@query(f"with {USER} select stream_name, sum(n)::bigint as events from (select stream_name, count(*) as n from log where substr(stream_name, 6)::int < 8 group by 1) group by 1")
def stored_index(spark, d):
    """Spans of eight streams ingested twice into a stored index; each event is in it once."""
    from ..operators.epochs import StreamSpan
    from ..sources.indexes import StoredIndex
    from ..sources.store import LogStore

    log = user(spark, d).where(N.stream_id("stream_name").cast("int") < 8)
    cut = spans.spans_of(log, 50).orderBy("stream_name", "i").collect()
    index = StoredIndex(LogStore(spark, shared_path(spark, "log")), max_version=3)
    for _ in range(2):
        for first in sorted({r.i for r in cut}):
            index.ingest([StreamSpan(r.stream_name, r.i, tuple(r.c)) for r in cut if r.i == first])
    return index.changes().groupBy("stream_name").agg(F.sum(F.size("c")).cast("long").alias("events"))


@query(f"with {USER}, m as (select max(time) as t from log) select stream_name, 'User' as category, min(position) as first_index, max(position) as last_index, count(*) as events, (epoch_us((select t from m)) - epoch_us(max(time))) // 1000 as lead_ms from log group by 1")
def trace_attributes(spark, d):
    return scans.trace_attributes(user(spark, d))


@query(f"with {USER} select stream_name, position, type, value from log where substr(stream_name, 6)::int % 3 = 0")
def span_hydration_of_some(spark, d):
    log = user(spark, d)
    some = N.stream_id("stream_name").cast("int") % 3 == 0
    return spans.hydrate(spans.spans_of(log, 4), log.select("stream_name", "position", "type", "value"), some)


@query(f"with {USER} select position || ' ' || type as line from log where stream_name = 'User-2'")
def stream_dump_text(spark, d):
    return scans.dumped(user(spark, d).withColumn("data", F.lit(None).cast("string")), "User-2", text=True)
