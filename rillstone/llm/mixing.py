"""Mixing sources to target weights, with DataFrame functions only.

A document is taken floor(rate) times, and once more when a number hashed from a seed and its doc_id is below the rest of
the rate. Documents' sizes differ by four orders, so one draw of such numbers may miss a source's target widely; each
source uses that of DRAWS seeds whose taken words, summed for every seed before anything is joined, come nearest to it.

Sizes are counted once and summed for each source, so a source that holds a third of all rows costs one row for each task.
The plan of a mix is a table of one row a source; Spark broadcasts it only while its measured size allows that, and
otherwise splits the hot source's join partition (adaptive execution).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, table, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
DRAWS = 32


def source_targets(sized: DataFrame, weights=WEIGHTS, most=MOST) -> DataFrame:
    """(source, source_size, target), one row a source of (source, size).

    Sources in code point order, null last, take the weights in turn and share the sum of all sizes. A target stops
    at `most` times its source's size and the excess goes to the others by weight. That is filling water to one level:
    with sources ordered by cap over weight, the level is the largest of (all - caps before) / (weights from here).
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((turn - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("turn", turn).withColumn("weight", weight.cast("long"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most).cast("long"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "turn")
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    whole = F.sum("source_size").over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("level", (whole - before).cast("double") / onward)
    level = F.max("level").over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("cap").cast("double"), level * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def chance(seed: str, draw: Column, doc_id: Column) -> Column:
    """A number in [0, 1) hashed from the seed, the number of the draw and a doc_id (null: empty); an md5 has two."""
    name = F.concat(F.lit(f"{seed}-"), F.floor(draw / 2).cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digits = F.substring(F.md5(name), (draw % 2).cast("int") * 16 + 1, F.lit(12))
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**12))


def source_plan(docs: DataFrame, weights=WEIGHTS, most=MOST, seed=SEED, draws=DRAWS) -> DataFrame:
    """(source, source_size, target, rate, draw): a row for each source, with the draw whose taken words are nearest to its
    target, the first of equals."""
    sized = written(docs.select("source", "doc_id", n_words("text").alias("size")), "mix-sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = written(source_targets(sized, weights, most).withColumn("rate", rate).withColumnRenamed("source", "of"), "mix-targets")
    drawn = sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
    more = [F.sum(F.when(chance(seed, F.lit(k), F.col("doc_id")) < F.col("rate") - F.floor("rate"), F.col("size")).otherwise(0)) for k in range(draws)]
    sums = drawn.groupBy("of", "source_size", "target", "rate").agg(F.array(*more).alias("more"))
    off = F.transform("more", lambda x, k: F.struct(F.abs(F.floor("rate") * F.col("source_size") + x - F.col("target")).alias("off"), k.alias("k")))
    return written(sums.select(F.col("of").alias("source"), "source_size", "target", "rate", F.array_min(off)["k"].alias("draw")), "mix-plan")


def copies(seed: str, doc_id: Column) -> Column:
    """How often a document is taken, beside the columns of its source's plan."""
    more = chance(seed, F.col("draw"), doc_id) < F.col("rate") - F.floor("rate")
    return (F.floor("rate") + F.when(more, 1).otherwise(0)).cast("long")


def planned(docs: DataFrame, weights=WEIGHTS, most=MOST, seed=SEED, draws=DRAWS) -> DataFrame:
    """(row, source_size, target, copies): the rows of docs as structs, with their source's size and target and the times
    they are taken.

    Rate is target over size of the source; a source without words has 0. Null or empty texts have size 0 and are copied
    at their source's rate; a null source is one of its own. Equal rows get equal copies. An empty table gives none.
    """
    plan = source_plan(docs, weights, most, seed, draws).withColumnRenamed("source", "of")
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(plan, F.col("row.source").eqNullSafe(F.col("of")), "left")
    return joined.select("row", "source_size", "target", copies(seed, F.col("row.doc_id")).alias("copies"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, most=MOST, seed=SEED, draws=DRAWS) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of `docs`. An empty table gives none."""
    taken = planned(docs, weights, most, seed, draws).where("copies > 0")
    taken = taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return taken.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op10_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = docs.select("doc_id", "source", n_words("text").alias("size"))  # before the join, so that texts need not travel for it
    plan = source_plan(docs).withColumnRenamed("source", "of")
    joined = sized.join(plan, F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(SEED, F.col("doc_id"))).alias("taken"))


ORACLE = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source asc nulls last) as turn
  from sized group by source
), weighed as (
  select *, case (turn - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, source_size * 3 as cap from per
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / weight, turn
      rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by cap::double / weight, turn rows between current row and unbounded following))::double as level
  from weighed
), targets as (
  select source, source_size, least(cap::double, max(level) over () * weight) as target from levels
), joined as (
  select doc_id, sized.source, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate
  from sized left join targets on sized.source is not distinct from targets.source
), drawn as (
  select *, ('0x' || substr(md5('mix-1-' || (k // 2) || ':' || coalesce(cast(doc_id as varchar), '')), (1 + 16 * (k % 2))::int, 12))::bigint
    / 281474976710656.0::double as chance
  from joined cross join (select unnest(range(32)) as k)
), missed as (
  select source, k,
    abs(any_value(floor(rate)) * any_value(source_size) + sum(case when chance < rate - floor(rate) then size else 0 end) - any_value(target)) as off
  from drawn group by source, k
), chosen as (
  select source, k from missed qualify row_number() over (partition by source order by off, k) = 1
)
select doc_id, size, source_size, target,
  (size * (floor(rate)::bigint + case when chance < rate - floor(rate) then 1 else 0 end))::bigint as taken
from drawn join chosen on drawn.source is not distinct from chosen.source and drawn.k = chosen.k
"""
