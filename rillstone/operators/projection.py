"""Read models: changes of one key are collapsed to at most one, which a keyed merge then applies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIONS = ("Insert", "Update", "Upsert", "Delete")
CHANGE = "struct<action:string,data:map<string,string>>"


def change(action: str, **data) -> dict:
    """A change record; values as text."""
    if action not in ACTIONS:
        raise ValueError(f"unknown action: {action}")
    return {"action": action, "data": {k: None if v is None else str(v) for k, v in data.items()}}


def changes_for(keys: tuple[str, ...], columns: tuple[str, ...]) -> dict[str, Callable[..., dict]]:
    """A builder for each action of a read model with these keys and further columns: each needs all keys, takes no other
    names, and gives a change()."""

    def builder(action: str) -> Callable[..., dict]:
        def build(**data) -> dict:
            if missing := [k for k in keys if data.get(k) is None]:
                raise ValueError(f"{action} without {', '.join(missing)}")
            if unknown := sorted(set(data) - {*keys, *columns}):
                raise ValueError(f"{action} with unknown {', '.join(unknown)}")
            return change(action, **data)

        return build

    return {action: builder(action) for action in ACTIONS}


def merged(a: Column, b: Column) -> Column:
    """Members of b over those of a."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(F.map_contains_key(b, k), y).otherwise(x))


def joined_change(a: Column, b: Column) -> Column:
    """Two changes as one; null where they cancel out. What can't follow raises."""
    was, now = a["action"], b["action"]
    both = lambda action: F.struct(F.lit(action).alias("action"), merged(a["data"], b["data"]).alias("data"))
    wrong = F.raise_error(F.concat(now, F.lit(" can't follow "), was)).cast(CHANGE)
    after_insert = F.when(now == "Insert", wrong).when(now == "Delete", F.lit(None).cast(CHANGE)).otherwise(both("Insert"))
    after_update = F.when(now == "Insert", wrong).when(now == "Update", both("Update")).otherwise(b)
    after_upsert = F.when(now == "Insert", wrong).when(now == "Delete", b).otherwise(both("Upsert"))
    again = F.struct(F.lit("Upsert").alias("action"), b["data"].alias("data"))
    after_delete = F.when(now == "Insert", again).when(now == "Update", wrong).otherwise(b)
    return F.when(was == "Insert", after_insert).when(was == "Update", after_update).when(was == "Upsert", after_upsert).otherwise(after_delete)


def collapse(changes: DataFrame, *keys: str) -> DataFrame:
    """(keys, action, data): changes (keys, seq, action, data) of each key folded in order of seq. Keys whose changes
    cancel out are missing. A batch's changes of one key are held together, so batches bound them."""
    # a map can't be ordered, so rows are put in order by seq alone
    rows = F.collect_list(F.struct("seq", F.struct("action", "data").alias("change")))
    order = lambda x, y: F.when(x["seq"] < y["seq"], -1).when(x["seq"] > y["seq"], 1).otherwise(0)
    grouped = changes.groupBy(*keys).agg(F.array_sort(rows, order).alias("__c"))
    fold = F.aggregate("__c", F.lit(None).cast(CHANGE), lambda a, c: F.when(a.isNull(), c["change"]).otherwise(joined_change(a, c["change"])))
    return grouped.select(*keys, fold.alias("__x")).where("__x is not null").select(*keys, "__x.action", "__x.data")


def apply(table: DataFrame, changes: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """The read model after collapsed changes (keys, action, data), at most one a key.

    With a version column a change counts only where the stored version is less than its own, and Insert acts as
    Upsert; without one an Insert of a stored key does nothing. Update of a missing row does nothing. Delete takes a row
    only if all members that it gives agree (the version aside); it leaves no mark. Members a change lacks are kept."""
    columns = table.columns
    named = changes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("action").alias("__a"), F.col("data").alias("__d"))
    rows = table.withColumn("__old", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    both = rows.join(named, on, "full")
    old, act = F.coalesce(F.col("__old"), F.lit(False)), F.col("__a")
    given = lambda c: F.map_contains_key("__d", F.lit(c))
    new = lambda c: F.col("__d")[c].cast(table.schema[c].dataType)
    newer = F.lit(True) if version is None else F.coalesce(F.col(version) < new(version), F.lit(True))
    alike = F.lit(True)
    for c in columns:
        if c != version and c not in keys:
            alike = alike & (~given(c) | F.col(c).eqNullSafe(new(c)))
    upserts = act.isin("Upsert", "Insert") if version else (act == "Upsert")
    sets = F.coalesce((old & newer & (upserts | (act == "Update"))) | (~old & act.isin("Insert", "Upsert")), F.lit(False))
    gone = F.coalesce(old & (act == "Delete") & newer & alike, F.lit(False))
    value = lambda c: F.when(sets & given(c), new(c)).otherwise(F.col(c))
    kept = both.where((old & ~gone) | (~old & sets))
    return kept.select(*[(F.coalesce(F.col(c), F.col(f"__k_{c}")) if c in keys else value(c)).alias(c) for c in columns])


def project(table: DataFrame, changes: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """One batch: collapse, then apply."""
    return apply(table, collapse(changes, *keys), keys, version)


def handler(store, name: str, keys: list[str], version: str | None, to_changes: Callable[[DataFrame], DataFrame]) -> Callable:
    """A foreachBatch function that keeps a read model in `store`, a LogStore; to_changes makes
    (keys, seq, action, data) of a micro-batch. With a version column a batch that comes again changes nothing."""

    from ..sources.store import retried

    def run(batch: DataFrame, batch_id: int) -> None:
        def once():
            at = store.at(name)
            if at is None:
                raise KeyError(name)
            store.replace(name, project(batch.sparkSession.read.parquet(at), to_changes(batch), keys, version), at)

        retried(once)

    return run
