"""Model tables derived from the stored TPC-H-style tables.

The mapping (products from ``part``, orders from ``orders``, items from
``lineitem``, stock deltas and order lifecycle events from ``events``) keeps
the driver tables' bigint keys: joins and shuffles on longs are cheaper than
on UUID strings, and every operator is generic in the key type.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import sku_of
from .tables import table

# --- fixed values of the mapping -------------------------------------------
STOCK_FACTOR, STOCK_MODULUS = 37, 121     # stock_quantity = key * 37 mod 121
LEDGER_START = 300                       # opening balance of every ledger product
EPOCH_2024 = dt.datetime(2024, 1, 1)     # created_at base of products
FORECAST_EVENT_BASE = dt.datetime(2024, 1, 10, 12, 0, 0)
FORECAST_EVENT_SPREAD = 15               # forecast event day = base + key mod 15
ORDER_KEY_SCALE = 100000                 # lifecycle order key = user * 1e5 + epoch day
STATUS_OF_CODE = {"F": "DELIVERED", "O": "CONFIRMED", "P": "PENDING"}
ACTION_OF_EVENT = {"view": "CONFIRM", "click": "SHIP", "purchase": "DELIVER", "error": "CANCEL"}
DELTA_SIGN = {"signup": 1, "view": 1, "purchase": -1, "click": -1}
JOB_ACTION_OF_EVENT = {"signup": "START", "click": "START", "view": "COMPLETE", "error": "FAIL"}


def _ntz(value: dt.datetime):
    return F.lit(value).cast("timestamp_ntz")


def products(spark: SparkSession, base: str) -> DataFrame:
    p = table(spark, base, "part", "p_partkey", "p_name", "p_type", "p_retailprice")
    created = _ntz(EPOCH_2024) + F.make_dt_interval(secs=F.col("p_partkey").cast("int"))
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        sku_of("p_partkey").alias("sku"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(12,2)").alias("price"),
        ((F.col("p_partkey") * STOCK_FACTOR) % STOCK_MODULUS).cast("int").alias("stock_quantity"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.lit(0).cast("bigint").alias("version"),
    )


def discontinued(spark: SparkSession, base: str) -> DataFrame:
    """Products that were taken off the range (fixture rule: parts of size 50)."""
    return table(spark, base, "part", "p_partkey", "p_size").where(F.col("p_size") == 50).select(
        F.col("p_partkey").alias("product_id"))


def _status_of(code) -> F.Column:
    expr = None
    for k, v in STATUS_OF_CODE.items():
        expr = F.when(code == k, v) if expr is None else expr.when(code == k, v)
    return expr


def orders(spark: SparkSession, base: str) -> DataFrame:
    o = table(spark, base, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        _status_of(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.lit(0).cast("bigint").alias("version"),
    )


def order_items(spark: SparkSession, base: str) -> DataFrame:
    li = table(spark, base, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        sku_of("l_partkey").alias("sku"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"),
    )


def confirmed_items(spark: SparkSession, base: str) -> DataFrame:
    """Items of orders that are past PENDING, with the order's instant.

    lineitem and orders are both large: this is a shuffle join on the order
    key; the status filter is pushed into the orders scan first.
    """
    o = (table(spark, base, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
         .where(F.col("o_orderstatus") != "P"))
    li = table(spark, base, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("quantity"),
        F.col("o_orderdate").alias("occurred_at"),
    )


def stock_deltas(spark: SparkSession, base: str) -> DataFrame:
    """Signed stock movements: + for signup/view, - for purchase/click, errors dropped."""
    return deltas_of(table(spark, base, "events", "event_id", "ts", "user_id", "event_type", "value"))


def deltas_of(e: DataFrame) -> DataFrame:
    """The delta mapping on any events frame (batch or stream)."""
    sign = (F.when(F.col("event_type").isin("signup", "view"), 1)
            .when(F.col("event_type").isin("purchase", "click"), -1))
    return (e.where(F.col("event_type").isin(*DELTA_SIGN))
            .select(F.col("user_id").alias("product_id"),
                    F.col("ts"),
                    F.col("event_id"),
                    (sign * F.floor("value")).cast("bigint").alias("delta")))


def ledger_opening(spark: SparkSession, base: str) -> DataFrame:
    """Opening balance per ledger product (every product seen in the deltas)."""
    return (table(spark, base, "events", "user_id", "event_type")
            .where(F.col("event_type").isin(*DELTA_SIGN))
            .select(F.col("user_id").alias("product_id")).distinct()
            .withColumn("opening", F.lit(LEDGER_START).cast("bigint")))


def order_lifecycle_events(spark: SparkSession, base: str) -> DataFrame:
    """Lifecycle commands per synthetic order (user, day): view confirms,
    click ships, purchase delivers, error cancels; signups are ignored."""
    e = table(spark, base, "events", "event_id", "ts", "user_id", "event_type")
    action = None
    for k, v in ACTION_OF_EVENT.items():
        action = F.when(F.col("event_type") == k, v) if action is None else action.when(
            F.col("event_type") == k, v)
    return (e.where(F.col("event_type").isin(*ACTION_OF_EVENT))
            .select((F.col("user_id") * ORDER_KEY_SCALE
                     + F.unix_date(F.to_date("ts")).cast("bigint")).alias("order_id"),
                    F.col("ts"), F.col("event_id"), action.alias("action")))


def _day_key(user: str = "user_id", ts: str = "ts"):
    return (F.col(user) * ORDER_KEY_SCALE + F.unix_date(F.to_date(ts)).cast("bigint"))


def _mapped(col_name: str, mapping: dict):
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(col_name) == k, v) if expr is None else expr.when(F.col(col_name) == k, v)
    return expr


def job_lifecycle_events(spark: SparkSession, base: str) -> DataFrame:
    """Forecast-job commands per synthetic job (user, day): signup and click
    start, view completes, error fails; purchases are ignored."""
    e = table(spark, base, "events", "event_id", "ts", "user_id", "event_type")
    return (e.where(F.col("event_type").isin(*JOB_ACTION_OF_EVENT))
            .select(_day_key().alias("job_id"), "ts", "event_id",
                    _mapped("event_type", JOB_ACTION_OF_EVENT).alias("action")))


def forecast_event_time(product_col: str = "product_id"):
    """Instant at which a product's forecast result is published (fixture rule)."""
    return _ntz(FORECAST_EVENT_BASE) + F.make_dt_interval(
        days=(F.col(product_col) % FORECAST_EVENT_SPREAD).cast("int"))


# --- fixed values: faults for the constraint audit -----------------------------
#: Per table a number of each row (SQL of Spark and of DuckDB) and, in order, the
#: columns that are broken in place with their broken value (SQL that both read).
#: The k-th fault hits the rows whose number modulo FAULT_MODULUS is k.
FAULT_MODULUS = 97
FAULTS = {
    "products": ("product_id", "product_id", [
        ("product_id", "NULL"), ("name", "NULL"), ("sku", "NULL"), ("category", "NULL"), ("price", "NULL"), ("stock_quantity", "NULL"),
        ("created_at", "NULL"), ("updated_at", "NULL"), ("version", "NULL"), ("name", "repeat('x', 256)"), ("sku", "repeat('x', 51)"),
        ("category", "repeat('x', 101)"), ("price", "-1"), ("stock_quantity", "-1"), ("product_id", "1"), ("sku", "'SKU-000001'")]),
    "orders": ("id", "id", [
        ("id", "NULL"), ("customer_id", "NULL"), ("status", "NULL"), ("created_at", "NULL"), ("updated_at", "NULL"), ("version", "NULL"),
        ("status", "repeat('x', 21)"), ("status", "'LOST'"), ("id", "1")]),
    "order_items": ("order_id", "order_id", [
        ("order_id", "NULL"), ("product_id", "NULL"), ("sku", "NULL"), ("quantity", "NULL"), ("unit_price", "NULL"),
        ("sku", "repeat('x', 51)"), ("quantity", "0"), ("unit_price", "-1"), ("order_id", "-1")]),
    "forecast_jobs": ("product_id", "product_id", [
        ("id", "NULL"), ("product_id", "NULL"), ("sku", "NULL"), ("horizon_days", "NULL"), ("status", "NULL"), ("created_at", "NULL"),
        ("updated_at", "NULL"), ("version", "NULL"), ("sku", "repeat('x', 51)"), ("status", "repeat('x', 21)"),
        ("model_used", "repeat('x', 51)"), ("error_message", "repeat('x', 1001)"), ("status", "'LOST'"), ("horizon_days", "366"),
        ("id", "'same'")]),
    "forecast_points": ("unix_date(forecast_date)", "date_diff('day', DATE '1970-01-01', forecast_date)", [
        ("job_id", "NULL"), ("forecast_date", "NULL"), ("predicted_quantity", "NULL"), ("lower_bound", "NULL"), ("upper_bound", "NULL"),
        ("predicted_quantity", "-1"), ("job_id", "'gone'")]),
    "alerts": ("product_id", "product_id", [
        ("id", "NULL"), ("type", "NULL"), ("severity", "NULL"), ("product_id", "NULL"), ("sku", "NULL"), ("title", "NULL"),
        ("message", "NULL"), ("occurred_at", "NULL"), ("type", "repeat('x', 31)"), ("severity", "repeat('x', 21)"),
        ("product_id", "repeat('9', 256)"), ("sku", "repeat('x', 51)"), ("title", "repeat('x', 256)"), ("id", "'same'")]),
}


def with_faults(df: DataFrame, table: str) -> DataFrame:
    """The rows of a model table, some broken as FAULTS says."""
    number, _, faults = FAULTS[table]
    hit = F.expr(f"{number} % {FAULT_MODULUS}")
    out = []
    for c in df.columns:
        kind = "string" if (table, c) == ("alerts", "product_id") else df.schema[c].dataType.simpleString()
        value = F.col(c).cast(kind)
        for k, (column, broken) in enumerate(faults):
            if column == c:
                value = F.when(hit == k, F.expr(f"CAST({broken} AS {kind})")).otherwise(value)
        out.append(value.alias(c))
    return df.select(*out)
