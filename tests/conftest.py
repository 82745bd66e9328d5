import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same(spark, sf):
    """Compares a query with its SQL in DuckDB: column names, and rows in any order."""
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")

    def check(query, sql):
        found = query(spark, sf)
        names = sorted(found.columns)
        wanted = con.sql(sql)
        assert names == sorted(wanted.columns)
        at = [wanted.columns.index(n) for n in names]
        rows = sorted(repr(tuple(r[n] for n in names)) for r in found.collect())
        assert rows == sorted(repr(tuple(r[i] for i in at)) for r in wanted.fetchall())

    return check
