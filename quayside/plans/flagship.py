"""The flagship plan: order demand -> forecasts -> stock-aware alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog


def flagship(spark: SparkSession, base: str) -> DataFrame:
    return catalog.q_all_alerts(spark, base)
