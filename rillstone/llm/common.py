"""What the corpus operators share: tables, written intermediate results and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\\x20\\x09-\\x0D]+"


#: Paths of this process's intermediate tables, which clean() removes.
WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='rillstone-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, kind: str = "step") -> DataFrame:
    """`df` written once as Parquet into the shared folder and read back: a lost executor costs a task, not the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/rillstone/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes the intermediate tables; for when nothing that was made of them is still to be computed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while WRITTEN:
        at = path(WRITTEN.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it while df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text) -> F.Column:
    """Number of words of the contracts; null text has none."""
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')"), F.lit(0)).cast("long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id that has a link; component is the smallest id that is reachable.

    links: (a long, b long), in any direction and number. Rounds of large-star and small-star: each keeps
    connectivity, and the number of rounds is logarithmic in practice. A hub's links are only ever joined
    with one row (the hub's minimum), so a hot id makes no more rows than it has links.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = written(small, "small-star")
        # it is a forest of stars when no centre has a parent and each id has one
        state = small.groupBy().agg(F.count("*").alias("n"), F.countDistinct("u").alias("d")).first()
        centres = small.select(F.col("v").alias("u")).distinct().join(small, "u", "left_semi").limit(1).count()
        edges = small
        if state.n == state.d and not centres:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
