import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


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
def duck():
    import duckdb

    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(x):
    """A value that compares across engines."""
    import pandas as pd

    if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(x, 6) if isinstance(x, float) else x if isinstance(x, int) else str(x)


def rows_of(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def check(query, sql):
        got, want = rows_of(query(spark, SF).toPandas()), rows_of(duck.sql(sql).df())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return check
