"""Folds of a stream's events into state.

Algebraic folds are plain aggregates, combined before the shuffle. Folds that depend on order run as one ordered
`aggregate` over a stream's events; very long streams should use `timeline` (a window) or snapshots instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(log: DataFrame, initial: Column, step: Callable, *columns: str, finish: Callable | None = None) -> DataFrame:
    """(stream_name, state, version): a left fold from `initial` in order of position. version counts all events, also
    those that the step ignores."""
    events = F.array_sort(F.collect_list(F.struct("position", *columns)))
    grouped = log.groupBy("stream_name").agg(events.alias("__e"), (F.max("position") + 1).alias("version"))
    folded = F.aggregate("__e", initial, step) if finish is None else F.aggregate("__e", initial, step, finish)
    return grouped.select("stream_name", folded.alias("state"), "version")


def by_handlers(handlers: dict[str, Callable], type_of=lambda e: e["type"]) -> Callable:
    """A step from one handler (state, event) -> state a type; other types leave the state."""

    def step(state, event):
        out = state
        for name, f in handlers.items():
            out = F.when(type_of(event) == name, f(state, event)).otherwise(out)
        return out

    return step


def counter(log: DataFrame, amount: str = "value") -> DataFrame:
    return log.groupBy("stream_name").agg(F.sum(amount).alias("total"), F.count("*").alias("version"))


def latest(log: DataFrame, *columns: str, deleted: str | None = None) -> DataFrame:
    """The last event's columns for each stream; null where that event deletes."""
    last = log.groupBy("stream_name").agg(F.max_by(F.struct("type", *columns), "position").alias("e"))
    value = lambda c: F.when(F.col("e.type") == deleted, None).otherwise(F.col(f"e.{c}")) if deleted else F.col(f"e.{c}")
    return last.select("stream_name", *[value(c).alias(c) for c in columns])


def invoice(log: DataFrame) -> DataFrame:
    """(stream_name, status, amount, payer, amount_paid, references, illegal).

    A payment counts once for each reference. illegal counts transitions that a strict fold refuses: events before the
    invoice is raised, a second raise, or anything after it is finalized."""
    is_ = lambda t: F.col("type") == t
    paid = is_("PaymentReceived")
    # a row for each reference of a stream, and one for what is no payment: the first of its reference needs no window
    each = log.groupBy("stream_name", F.when(paid, F.col("reference")).alias("reference"), paid.alias("paid")).agg(
        F.min_by("amount", "position").alias("first"),
        F.sum(F.when(is_("InvoiceRaised"), F.col("amount"))).alias("amount"),
        F.max(F.when(is_("InvoiceRaised"), F.col("payer"))).alias("payer"),
        F.sum(F.when(is_("InvoiceRaised"), 1).otherwise(0)).alias("raises"),
        F.min(F.when(is_("InvoiceRaised"), F.col("position"))).alias("raised_at"),
        F.min(F.when(is_("InvoiceFinalized"), F.col("position"))).alias("final_at"),
        F.max("position").alias("last"),
    )
    per = each.groupBy("stream_name").agg(
        F.sum("amount").alias("amount"), F.max("payer").alias("payer"), F.sum(F.when(F.col("paid"), F.col("first"))).alias("paid"),
        F.sum(F.when(F.col("paid"), 1).otherwise(0)).alias("references"), F.sum("raises").alias("raises"),
        F.min("raised_at").alias("raised_at"), F.min("final_at").alias("final_at"), F.max("last").alias("last"),
    )
    status = F.when(F.col("raised_at").isNull(), "initial").when(F.col("final_at").isNotNull(), "finalized").otherwise("raised")
    illegal = F.coalesce(F.col("raised_at"), F.col("last") + 1) + F.greatest(F.col("raises") - 1, F.lit(0)) + F.coalesce(F.col("last") - F.col("final_at"), F.lit(0))
    return per.select(
        "stream_name", status.alias("status"), F.col("amount").cast("double").alias("amount"), "payer",
        F.coalesce(F.col("paid"), F.lit(0)).cast("double").alias("amount_paid"), F.col("references").cast("long").alias("references"),
        illegal.cast("long").alias("illegal"),
    )


def guest_stay(log: DataFrame, charge=("purchase",), pay=("view",), out=("signup",), amount: str = "value") -> DataFrame:
    """(stream_name, balance, charges, payments, state): balance is charges less payments in cents; state is closed if
    the stream has a check-out."""
    cents = F.round(F.col(amount) * 100).cast("long")
    isin = lambda t: F.col("type").isin(*t)
    per = log.groupBy("stream_name").agg(
        F.coalesce(F.sum(F.when(isin(charge), cents)), F.lit(0)).alias("charged"),
        F.coalesce(F.sum(F.when(isin(pay), cents)), F.lit(0)).alias("paid"),
        F.max(isin(out)).alias("closed"),
    )
    state = F.when(F.col("closed"), "closed").otherwise("active")
    return per.select("stream_name", (F.col("charged") - F.col("paid")).alias("balance"), F.col("charged").alias("charges"), F.col("paid").alias("payments"), state.alias("state"))


def group_checkout(stays: DataFrame, payments: DataFrame) -> DataFrame:
    """(group, stays, merged, failed, balance, next_action) from stays (group, stay, residual, ok) and payments (group,
    paid): residuals of merged stays less payments. The next action is to merge while stays are pending, to confirm at
    a balance of 0, else to pay or wait."""
    per = stays.groupBy("group").agg(
        F.count("*").alias("stays"),
        F.sum(F.when(F.col("ok"), 1).otherwise(0)).alias("merged"),
        F.sum(F.when(~F.col("ok"), 1).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("ok").isNull(), 1).otherwise(0)).alias("pending"),
        F.sum(F.when(F.col("ok"), F.col("residual")).otherwise(0)).alias("residual"),
    )
    paid = payments.groupBy("group").agg(F.sum("paid").alias("paid"))
    both = per.join(paid, "group", "left").withColumn("balance", F.col("residual") - F.coalesce("paid", F.lit(0)))
    action = F.when(F.col("pending") > 0, "merge").when(F.col("failed") > 0, "wait").when(F.col("balance") == 0, "confirm").otherwise("pay")
    return both.select("group", "stays", "merged", "failed", "balance", action.alias("next_action"))


#: State of a cart: its lines, the last added first.
CART = "array<struct<sku:string,quantity:bigint,waived:boolean>>"


def cart(log: DataFrame) -> DataFrame:
    """(stream_name, state, version) of carts with events (type, sku, quantity, waived, and items, a CART, or without that
    column): ItemAdded puts a line first, ItemRemoved drops a sku's lines, ItemQuantityChanged and ItemPropertiesChanged set
    them (a quantity of 0 stays a line), Snapshotted replaces all lines. waived is null until it is set."""
    log = log if "items" in log.columns else log.withColumn("items", F.lit(None).cast(CART))

    def line(e, quantity, waived):
        return F.struct(e["sku"].alias("sku"), quantity.alias("quantity"), waived.alias("waived"))

    def each(s, e, quantity, waived):
        return F.transform(s, lambda x: F.when(x["sku"] == e["sku"], line(x, quantity(x), waived(x))).otherwise(x))

    step = by_handlers(
        {
            "Snapshotted": lambda s, e: F.coalesce(e["items"], F.array().cast(CART)),
            "ItemAdded": lambda s, e: F.concat(F.array(line(e, e["quantity"], e["waived"])), s),
            "ItemRemoved": lambda s, e: F.filter(s, lambda x: x["sku"] != e["sku"]),
            "ItemQuantityChanged": lambda s, e: each(s, e, lambda x: e["quantity"], lambda x: x["waived"]),
            "ItemPropertiesChanged": lambda s, e: each(s, e, lambda x: x["quantity"], lambda x: e["waived"]),
        }
    )
    return ordered(log, F.array().cast(CART), step, "type", "sku", "quantity", "waived", "items")


def bounded_counter(log: DataFrame, up: str, down: str, low: int = 0, high: int = 10) -> DataFrame:
    """(stream_name, state, version): up counts only below `high`, down only above `low`."""
    step = by_handlers(
        {
            up: lambda s, _: F.when(s < high, s + 1).otherwise(s),
            down: lambda s, _: F.when(s > low, s - 1).otherwise(s),
        }
    )
    return ordered(log, F.lit(low).cast("long"), step, "type")


def appointments(log: DataFrame, begin: str, end: str) -> DataFrame:
    """(stream_name, status, duration_ms, version): from the last begin to the last end."""
    at = lambda t: F.max_by(F.when(F.col("type") == t, F.col("time")), F.when(F.col("type") == t, F.col("position")))
    per = log.groupBy("stream_name").agg(at(begin).alias("b"), at(end).alias("e"), (F.max("position") + 1).alias("version"))
    ms = F.expr("(unix_micros(cast(e as timestamp)) - unix_micros(cast(b as timestamp))) div 1000")
    status = F.when(F.col("e").isNotNull(), "ended").when(F.col("b").isNotNull(), "begun").otherwise("pending")
    return per.select("stream_name", status.alias("status"), ms.alias("duration_ms"), "version")


def timeline(log: DataFrame, delta: Column, decodable: Column) -> DataFrame:
    """log with `state`, the running sum of delta after each event, and `decodable`; what can't be decoded changes
    nothing."""
    w = Window.partitionBy("stream_name").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("decodable", decodable).withColumn("state", F.sum(F.when(F.col("decodable"), delta).otherwise(0)).over(w))


def with_positions(events: DataFrame, base: DataFrame, order: str) -> DataFrame:
    """events with the positions an append gives them: each stream's version and on, in order; base: (stream_name,
    version), 0 where a stream is new."""
    w = Window.partitionBy("stream_name").orderBy(order)
    joined = events.withColumn("__n", F.row_number().over(w) - 1).join(base, "stream_name", "left")
    return joined.withColumn("position", F.coalesce("version", F.lit(0)) + F.col("__n")).drop("__n", "version")
