"""The SQL surface: texts run over the fixture tables as temporary views."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A text over views of the tables that it names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text)
