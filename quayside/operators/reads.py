"""Filtered and projected reads, per-key lookups, parent/child joins and
derived totals over the model tables.

The reference answers these one request at a time; here each one takes a
table of requests (or a filter value) and answers all of them in one plan.
Filters are plain predicates so Catalyst pushes them into the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


# ------------------------------------------------------------------ P1
def product_view(products: DataFrame) -> DataFrame:
    """Every product field except the version counter."""
    return products.drop("version")


# ------------------------------------------------------------------ A1
def order_totals(items: DataFrame, order_key: str = "order_id") -> DataFrame:
    """Exact decimal total per order: sum of unit_price x quantity; never stored."""
    return items.groupBy(order_key).agg(
        F.sum(F.col("unit_price") * F.col("quantity")).cast("decimal(18,2)").alias("total"))


# ------------------------------------------------------------------ J1, P2
#: Items of an order that stay together; a larger order is dealt out in pieces.
PIECE = 10_000


def _pieces(orders: DataFrame, items: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Headers and items by (order, piece).

    An order of n items has ceil(n / limit) pieces, almost always one. Items go to a
    piece by a hash of their content (equal items stay together), headers are repeated
    for every piece, so a group-by or join on (order, piece) has no key that grows with
    an order. Counts and totals come from one partially aggregated group-by; only the
    large orders, a small checkpointed table (a row per ``limit`` items at most), are
    sent to the items, which are not moved for it. Headers carry ``n_items``, ``total``,
    ``n_pieces`` and ``piece``."""
    per = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n_items"),
                                        F.sum(F.col("unit_price") * F.col("quantity")).cast("decimal(18,2)").alias("total"))
    ensure_checkpoint_dir(items.sparkSession)
    large = per.where(F.col("n_items") > limit).select("order_id", F.ceil(F.col("n_items") / limit).cast("int").alias("n_pieces")).checkpoint(eager=True)
    own = F.pmod(F.xxhash64(*[c for c in items.columns if c != "order_id"]), F.coalesce("n_pieces", F.lit(1))).cast("int")
    placed = items.join(F.broadcast(large), "order_id", "left").withColumn("piece", own).drop("n_pieces")
    head = (orders.join(per.withColumnRenamed("order_id", "id"), "id", "left").select(*orders.columns, "n_items", "total")
            .withColumn("total", F.coalesce("total", F.lit(0).cast("decimal(18,2)")))
            .withColumn("n_pieces", F.greatest(F.lit(1), F.ceil(F.col("n_items") / limit).cast("int")))
            .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1))))
    return head, placed


def _flat(head: DataFrame, placed: DataFrame, columns: list[str]) -> DataFrame:
    """Headers with their items, one row per item; a header without items keeps one
    row, from a branch of its own, so the join is an inner one and splits on either
    side."""
    inner = head.where("n_items IS NOT NULL").withColumnRenamed("id", "order_id").join(placed, ["order_id", "piece"]).withColumnRenamed("order_id", "id")
    none = head.where("n_items IS NULL").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in placed.schema if f.name not in ("order_id", "piece")])
    return inner.select(*columns).unionByName(none.select(*columns))


def orders_with_items(orders: DataFrame, items: DataFrame, limit: int = PIECE) -> DataFrame:
    """Each order with its items (an order without items keeps one row)."""
    head, placed = _pieces(orders, items, limit)
    return _flat(head, placed, [*orders.columns, *(c for c in items.columns if c != "order_id")])


def order_view(orders: DataFrame, items: DataFrame, limit: int = PIECE) -> DataFrame:
    """Order header with items (each with its subtotal) and the order total, an array
    per piece: an order of more than ``limit`` items has a row for each of its
    ``n_pieces`` pieces, every one with the whole order's total."""
    head, placed = _pieces(orders, items, limit)
    # the bare items are moved, not arrays of them
    arrays = placed.repartition("order_id", "piece").select("order_id", "piece", F.struct(
        "product_id", "sku", "quantity", "unit_price",
        (F.col("unit_price") * F.col("quantity")).cast("decimal(18,2)").alias("subtotal")).alias("item"))
    arrays = arrays.groupBy("order_id", "piece").agg(F.array_sort(F.collect_list("item")).alias("items"))
    kind = arrays.schema["items"].dataType
    return (head.withColumnRenamed("id", "order_id").join(arrays, ["order_id", "piece"], "left").withColumnRenamed("order_id", "id")
            .select(*orders.columns, F.coalesce("items", F.array().cast(kind)).alias("items"), "total", "piece", "n_pieces"))


def order_view_flat(orders: DataFrame, items: DataFrame, limit: int = PIECE) -> DataFrame:
    """Flattened order view: one row per item with subtotal and the order total."""
    head, placed = _pieces(orders, items, limit)
    placed = placed.withColumn("subtotal", (F.col("unit_price") * F.col("quantity")).cast("decimal(18,2)"))
    return _flat(head, placed, [*orders.columns, *(c for c in placed.columns if c not in ("order_id", "piece")), "total"])


# ------------------------------------------------------------------ J2, O2
def jobs_with_points(jobs: DataFrame, points: DataFrame) -> DataFrame:
    """Each job with its points in ascending date order (empty when none). ``points``
    has a row per point, or rows with an array ``points`` of some points of a job:
    then a row is grouped and sorted per array, not per point."""
    if "points" in points.columns:
        all_ = F.flatten(F.collect_list("points"))
    else:
        all_ = F.collect_list(F.struct("forecast_date", "predicted_quantity", "lower_bound", "upper_bound"))
    pts = points.groupBy("job_id").agg(F.array_sort(all_).alias("points"))
    return jobs.join(pts, jobs["id"] == pts["job_id"], "left").drop("job_id")


# ------------------------------------------------------------------ P3
def forecast_job_view(jobs: DataFrame, points: DataFrame) -> DataFrame:
    """Job fields plus a nested result {model, mae, total demand, points}, null
    unless the job has a model result."""
    pts = points.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("forecast_date", "predicted_quantity",
                                             "lower_bound", "upper_bound"))).alias("_pts"),
        F.sum("predicted_quantity").cast("decimal(18,2)").alias("_total"))
    j = jobs.join(pts, jobs["id"] == pts["job_id"], "left")
    result = F.when(F.col("model_used").isNotNull(), F.struct(
        F.col("model_used").alias("modelUsed"), F.col("mae"),
        F.coalesce("_total", F.lit(0).cast("decimal(18,2)")).alias("totalPredictedDemand"),
        F.coalesce("_pts", F.array().cast(pts.schema["_pts"].dataType)).alias("points")))
    return j.select(*[F.col(c) for c in jobs.columns if c != "version"], result.alias("result"))


# ------------------------------------------------------------------ P4
def lookup_by_id(table: DataFrame, ids: DataFrame, key: str, id_col: str = "requested_id") -> DataFrame:
    """A batch of requested ids: the matching row or found = false."""
    r = ids.select(F.col(id_col).alias("_req")).distinct()
    return (r.join(table, r["_req"] == table[key], "left")
            .select(F.col("_req").alias(id_col), F.col(key).isNotNull().alias("found"),
                    *[table[c] for c in table.columns if c != key]))


# ------------------------------------------------------------------ P5..P10
def by_value(table: DataFrame, column: str, value=None) -> DataFrame:
    """Equality filter; no value means every row (the optional category filter)."""
    return table if value is None else table.where(F.col(column) == F.lit(value))


def products_by_category(products: DataFrame, category: str | None = None) -> DataFrame:
    return by_value(products, "category", category)


def product_by_sku(products: DataFrame, sku: str) -> DataFrame:
    return by_value(products, "sku", sku)


def orders_by_customer(orders: DataFrame, customers: DataFrame, key: str = "customer_id") -> DataFrame:
    """Orders of a batch of customers (semi join keeps only order columns)."""
    return orders.join(customers.select(F.col(key)).distinct(), key, "left_semi")


def orders_by_status(orders: DataFrame, status: str) -> DataFrame:
    return by_value(orders, "status", status)


def jobs_by_product(jobs: DataFrame, products: DataFrame, key: str = "product_id") -> DataFrame:
    return jobs.join(products.select(key).distinct(), key, "left_semi")


def jobs_by_status(jobs: DataFrame, status: str) -> DataFrame:
    return by_value(jobs, "status", status)


# ------------------------------------------------------------------ P11, O1
def alerts_query(alerts: DataFrame, sku: str | None = None, type_: str | None = None,
                 severity: str | None = None) -> DataFrame:
    """Only the first given filter applies (sku, then type, then severity);
    filtered reads come newest first (id breaks ties); no filter = all rows."""
    for column, value in (("sku", sku), ("type", type_), ("severity", severity)):
        if value is not None:
            return alerts.where(F.col(column) == value).orderBy(F.desc("occurred_at"), "id")
    return alerts


# ------------------------------------------------------------------ P13..P18
def confirmed_orders(order_events: DataFrame) -> DataFrame:
    """Confirmed orders only: placed orders may still be cancelled."""
    return order_events.where(F.col("eventType") == "ORDER_CONFIRMED")


def out_of_stock_signals(product_events: DataFrame) -> DataFrame:
    return product_events.where((F.col("eventType") == "STOCK_ADJUSTED") & (F.col("stockQuantity") == 0))


def product_deleted_signals(product_events: DataFrame) -> DataFrame:
    return product_events.where(F.col("eventType") == "PRODUCT_DELETED")


def low_stock_products(products: DataFrame, threshold: int = 10) -> DataFrame:
    """stock_quantity <= threshold (inclusive)."""
    return products.where(F.col("stock_quantity") <= threshold)


def terminal_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("COMPLETED", "FAILED"))


def route_events(forecast_events: DataFrame) -> DataFrame:
    """Route per event type: FAILED -> failure, COMPLETED with a total -> result,
    COMPLETED without a total and unknown types -> ignored."""
    route = (F.when(F.col("eventType") == "FORECAST_FAILED", "failure")
             .when((F.col("eventType") == "FORECAST_COMPLETED")
                   & F.col("totalPredictedDemand").isNotNull(), "result")
             .otherwise("ignored"))
    return forecast_events.withColumn("route", route)


# ------------------------------------------------------------------ W4, O4
def latest_forecast(jobs: DataFrame, key: str = "product_id") -> DataFrame:
    """Newest COMPLETED job per product (the smallest id breaks ties), by a partially
    aggregated minimum: a product that holds a third of all jobs is reduced before
    the shuffle, and no row is sorted. A job without an instant comes last."""
    done = jobs.where(F.col("status") == "COMPLETED")
    rest = [c for c in jobs.columns if c not in (key, "updated_at", "id")]
    # micros count down, so the newest is the least; id follows; the rest rides along
    newest = F.struct(F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit((1 << 63) - 1)).alias("_age"), "id", "updated_at", *rest)
    top = done.groupBy(key).agg(F.min(newest).alias("_top"))
    return top.select(*[F.col(key) if c == key else F.col(f"_top.{c}").alias(c) for c in jobs.columns])


# ------------------------------------------------------------------ J3, J4
def existing_skus(incoming: DataFrame, products: DataFrame) -> DataFrame:
    """Incoming rows whose SKU is already stored (semi join)."""
    return incoming.join(products.select("sku"), "sku", "left_semi")


def admit_new_products(incoming: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split new products into admitted and rejected.

    Rejected: SKU already stored ("SKU already exists: ..."), or a later
    duplicate inside the batch (the first by created_at, id wins).
    """
    fresh = incoming.join(products.select("sku"), "sku", "left_anti")
    # winner per SKU by a partially aggregated min: a SKU repeated by a third
    # of the batch is reduced map-side instead of sorted in one task
    order = F.struct("created_at", "product_id")
    first = fresh.groupBy("sku").agg(F.min(order).alias("_first"))
    marked = fresh.join(first, "sku").withColumn("_win", order == F.col("_first")).drop("_first")
    admitted = marked.where("_win").drop("_win")
    dup_store = incoming.join(products.select("sku"), "sku", "left_semi")
    rejected = (dup_store.unionByName(marked.where(~F.col("_win")).drop("_win"))
                .withColumn("reason", F.concat(F.lit("SKU already exists: "), F.col("sku"))))
    return admitted, rejected


# ------------------------------------------------------------------ J5
def orphan_children(children: DataFrame, parents: DataFrame, child_key: str,
                    parent_key: str = "id") -> DataFrame:
    """Child rows whose parent does not exist (anti join)."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


# ------------------------------------------------------------------ J6
def delete_cascade(parents: DataFrame, children: DataFrame, ids: DataFrame, child_key: str,
                   parent_key: str = "id", id_col: str = "requested_id"):
    """Remove the given parents and their children; report unknown ids.

    Returns (parents kept, children kept, unknown ids)."""
    req = ids.select(F.col(id_col).alias(parent_key)).distinct()
    kept_parents = parents.join(req, parent_key, "left_anti")
    kept_children = children.join(req.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")
    unknown = req.join(parents.select(parent_key), parent_key, "left_anti") \
        .select(F.col(parent_key).alias(id_col))
    return kept_parents, kept_children, unknown
