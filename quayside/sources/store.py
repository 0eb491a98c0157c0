"""Writes to the model tables without a MERGE-capable format: an upsert is a
full outer join of the stored table with the incoming rows, written as a new
version folder (never over the folder being read). The ``..._into`` forms read and
write only the buckets of a ``BucketTable`` that the incoming ids touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import BucketTable

PRODUCT_FIELDS = ("name", "sku", "category", "price", "stock_quantity")


# ------------------------------------------------------------------ S8
WRITE = ("updated_at", "write_no")


def _place(incoming: DataFrame) -> list[str]:
    """The columns that put writes in order: their instant and, where the batch
    numbers its writes, that number, which decides between equal instants."""
    return [c for c in WRITE if c in incoming.columns]


def _last_per_key(incoming: DataFrame, key: str, *more: Column) -> DataFrame:
    """Several writes to one id in a batch: the last one (by instant, then write
    number, then content) wins and each write counts for the version. A partially
    aggregated ``max_by``, so an id written by a large share of the batch is reduced
    map-side. ``more``: further aggregates of the same pass, kept as they are."""
    cols = [c for c in incoming.columns if c != key]
    o = F.struct(*_place(incoming), F.struct(*cols))
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*cols), o).alias("_last"),
                                     F.count(F.lit(1)).alias("_writes"), *more)
    return last.select(key, "_last.*", *last.columns[2:])


def upsert_products(stored: DataFrame, incoming: DataFrame, key: str = "product_id") -> DataFrame:
    """Known id: overwrite name, sku, category, price, stock; keep created_at;
    version + 1 per write. Unknown id: insert with version 0 (+1 per further
    write in the same batch). Untouched rows stay. Several writes to one id in
    a batch: the last by updated_at, then by write_no if there is one, wins."""
    s = stored.alias("s")
    i = _last_per_key(incoming, key).alias("i")
    j = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    new = F.col(f"i.{key}").isNotNull()
    cols = [F.coalesce(F.col(f"i.{key}"), F.col(f"s.{key}")).alias(key)]
    cols += [F.when(new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c) for c in PRODUCT_FIELDS]
    cols += [
        F.coalesce(F.col("s.created_at"), F.col("i.created_at")).alias("created_at"),
        F.when(new, F.col("i.updated_at")).otherwise(F.col("s.updated_at")).alias("updated_at"),
        F.when(new & F.col(f"s.{key}").isNotNull(), F.col("s.version") + F.col("i._writes"))
        .when(new, F.col("i._writes") - 1).otherwise(F.col("s.version")).cast("bigint").alias("version"),
    ]
    return j.select(*cols)


# ------------------------------------------------------------------ S9
def _version(key: str):
    """Version after an upsert: + 1 per write; an insert's first write gives 0."""
    new = F.col(f"i.{key}").isNotNull()
    return (F.when(new & F.col(f"s.{key}").isNotNull(), F.col("s.version") + F.col("i._writes"))
            .when(new, F.col("i._writes") - 1).otherwise(F.col("s.version")).cast("bigint").alias("version"))


def upsert_orders(stored: DataFrame, stored_items: DataFrame, incoming: DataFrame,
                  incoming_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known id: replace status and the items only; unknown: insert. Of several
    writes to one id in a batch the last by updated_at, then by write_no, wins. Items
    of changed orders are replaced as a whole (anti join + union); incoming items that
    carry their write's updated_at or write_no count only for the write that won."""
    last = _last_per_key(incoming, "id")
    s, i = stored.alias("s"), last.alias("i")
    j = s.join(i, F.col("s.id") == F.col("i.id"), "full_outer")
    new = F.col("i.id").isNotNull()
    orders = j.select(
        F.coalesce(F.col("i.id"), F.col("s.id")).alias("id"),
        F.coalesce(F.col("s.customer_id"), F.col("i.customer_id")).alias("customer_id"),
        F.when(new, F.col("i.status")).otherwise(F.col("s.status")).alias("status"),
        F.coalesce(F.col("s.created_at"), F.col("i.created_at")).alias("created_at"),
        F.when(new, F.col("i.updated_at")).otherwise(F.col("s.updated_at")).alias("updated_at"),
        _version("id"))
    changed = last.select(F.col("id").alias("order_id"), *_place(last))
    named = [c for c in _place(incoming_items) if c in changed.columns]
    if named:
        incoming_items = incoming_items.join(changed, ["order_id", *named], "left_semi")
    items = stored_items.join(changed, "order_id", "left_anti").unionByName(
        incoming_items.select(*stored_items.columns))
    return orders, items


# ------------------------------------------------------------------ S10
JOB_RESULT_FIELDS = ("model_used", "mae")


def upsert_forecast_jobs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known id: status, error message and updated_at always; model and mae only
    when a write carries a result (model_used present), else the old ones stay;
    created_at stays. Of several writes to one id in a batch the last by
    updated_at, then by write_no, wins, and the last that carries a result gives the
    result."""
    s = stored.alias("s")
    # one pass gives the last write and the last result; a null id has no stored job to match
    carries = F.col("id").isNotNull() & F.col("model_used").isNotNull()
    i = _last_per_key(incoming, "id", F.max(F.when(carries, _result_row(incoming))).alias("_result")).alias("i")
    j = s.join(i, F.col("s.id") == F.col("i.id"), "full_outer")
    new = F.col("i.id").isNotNull()
    cols = [F.coalesce(F.col("i.id"), F.col("s.id")).alias("id")]
    for c in ("product_id", "sku", "horizon_days", "created_at"):
        cols.append(F.coalesce(F.col(f"s.{c}"), F.col(f"i.{c}")).alias(c))
    for c in ("status", "error_message", "updated_at"):
        cols.append(F.when(new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    for c in JOB_RESULT_FIELDS:
        cols.append(F.when(F.col("i._result").isNotNull(), F.col(f"i._result.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    return j.select(*cols, _version("id"))


def _result_row(incoming: DataFrame) -> Column:
    """A write's place and result."""
    return F.struct(*_place(incoming), *[c for c in JOB_RESULT_FIELDS if c in incoming.columns])


def _last_results(incoming: DataFrame) -> DataFrame:
    """Per job the last write of a batch that carries a result."""
    return (incoming.where(F.col("model_used").isNotNull()).groupBy("id").agg(F.max(_result_row(incoming)).alias("_r"))
            .select("id", "_r.*"))


def replace_points(stored: DataFrame, jobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Forecast points after ``upsert_forecast_jobs`` with the writes ``jobs``: a job
    whose write carries a result gets the incoming points in place of all its old
    ones; the points of other jobs stay. Incoming points that carry their write's
    updated_at or write_no count only for the result that won, so of several results
    of one job in a batch one set of points stays."""
    # the points are many times the results: looked up in a hash table, not sorted
    won = _last_results(jobs).withColumnRenamed("id", "job_id").hint("shuffle_hash")
    named = [c for c in _place(incoming) if c in won.columns]
    # matched by job alone, the write's place compared as bounds: were it a join key,
    # points that lie by job would all be moved again
    i, w = incoming.alias("i"), won.alias("w")
    same = F.col("i.job_id") == F.col("w.job_id")
    for c in named:
        same &= (F.col(f"i.{c}") <= F.col(f"w.{c}")) & (F.col(f"i.{c}") >= F.col(f"w.{c}"))
    return stored.join(won, "job_id", "left_anti").unionByName(i.join(w, same, "left_semi").select(*stored.columns))


# ------------------------------------------------------------------ S8..S10 into buckets
def upsert_products_into(products: BucketTable, incoming: DataFrame, version: int) -> list[int]:
    """``upsert_products`` on the buckets that the incoming ids touch."""
    return products.update(version, incoming, upsert_products)


def upsert_orders_into(orders: BucketTable, items: BucketTable, incoming: DataFrame, incoming_items: DataFrame, version: int) -> list[int]:
    """``upsert_orders`` on the touched buckets of both tables (items are bucketed by
    their order, like the orders). Items are written first: an order's new version is
    never without its items, and the same write again replaces both."""
    if orders.buckets != items.buckets:
        raise ValueError("orders and items need the same buckets")
    touched = orders.touched(incoming, "id")
    o, i = upsert_orders(orders.read(version, touched), items.read(version, touched), incoming, incoming_items)
    items.write(i, version, touched)
    orders.write(o, version, touched)
    return touched


def upsert_jobs_into(jobs: BucketTable, points: BucketTable, incoming: DataFrame, incoming_points: DataFrame, version: int) -> list[int]:
    """``upsert_forecast_jobs`` and ``replace_points`` on the buckets that the written
    jobs touch; points are bucketed by their job."""
    if jobs.buckets != points.buckets:
        raise ValueError("jobs and points need the same buckets")
    touched = jobs.touched(incoming, "id")
    points.write(replace_points(points.read(version, touched), incoming, incoming_points), version, touched)
    jobs.write(upsert_forecast_jobs(jobs.read(version, touched), incoming), version, touched)
    return touched


# ------------------------------------------------------------------ S11
def append_alerts(alerts: DataFrame, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Insert-only. Ids already stored are skipped (replays and redeliveries
    write nothing twice). Returns the rows written."""
    new = alerts.dropDuplicates(["id"])
    if existing is not None:
        new = new.join(existing.select("id"), "id", "left_anti")
    new.write.mode("append").parquet(path)
    return new


def write_version(df: DataFrame, base: str, version: int) -> str:
    """Write a table version to its own folder; readers switch by version."""
    path = f"{base.rstrip('/')}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
