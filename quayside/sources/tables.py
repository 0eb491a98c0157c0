"""Reading the stored tables, with the columns a query needs only.

Selecting columns right at the read lets Catalyst prune the Parquet scan to
those columns; filters written after it are pushed into the scan as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df

