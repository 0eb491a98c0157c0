"""Structured Streaming versions of the event consumers.

Every job is ``readStream`` -> the same operators as the batch plan ->
``writeStream``. Consumers run their batch twin inside ``foreachBatch``; what must
outlive a micro-batch (balances, stock by day, alerts to deliver) lies in stored
tables whose folders carry the batch's number, so a batch that is tried again reads
what it read before and replaces what it wrote. All checkpoints live under the
session's shared ``spark.checkpoint.dir``, so a restarted query resumes where it
stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import alerts as AL
from ..operators import ledger as LG
from ..operators import notify as NT
from ..session import ensure_checkpoint_dir
from ..sources import events as EV
from .stock_index import LATEST, StockIndex, path_exists


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quayside-{name}-{uuid.uuid4().hex[:12]}"


def run_available_now(df: DataFrame, checkpoint: str, *, sink: Callable | None = None,
                      path: str | None = None, mode: str = "append", fmt: str = "parquet") -> None:
    """Process everything available, then stop (``trigger(availableNow=True)``)."""
    w = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode) \
        .trigger(availableNow=True)
    if sink is not None:
        q = w.foreachBatch(sink).start()
    else:
        q = w.format(fmt).option("path", path).start()
    q.awaitTermination()


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent micro-batch output: one folder per batch id, overwritten when
    a failed batch is retried, so a retry never duplicates rows."""
    # zstd: the ids, and the keys that a job's points repeat, take half of what snappy leaves
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


# ------------------------------------------------------------------ T8
class LedgerStore:
    """Ledger rows and balances of a stream, below one folder.

    ``rows/batch_id=k`` holds the ledger rows of micro-batch k, ``balances/batch_id=k``
    the closing balances of the products it touched, and every ``compact_every``
    batches ``snapshots/batch_id=k`` the balances of all products after batch k. The
    balances before a batch are the last snapshot below its number and the (at most
    ``compact_every``) batches since, so a batch that is tried again begins where it
    began the first time and replaces its own folders."""

    def __init__(self, path: str, opening: int = 300, compact_every: int = 16):
        self.path, self.opening, self.compact_every = path.rstrip("/"), opening, compact_every

    def _table(self, spark: SparkSession, name: str, schema: str) -> DataFrame | None:
        path = f"{self.path}/{name}"
        return spark.read.schema(f"{schema}, batch_id long").parquet(path) if path_exists(spark, path) else None

    def balances(self, spark: SparkSession, key_type: str, before: int) -> DataFrame | None:
        """(product_id, opening) of every product met before batch ``before``."""
        schema = f"product_id {key_type}, balance long"
        done, all_ = self._table(spark, "balances", schema), self._table(spark, "snapshots", schema)
        if done is None:
            return None
        done = done.where(F.col("batch_id") < before)
        if all_ is not None:
            at = all_.where(F.col("batch_id") < before).agg(F.max("batch_id")).first()[0]
            if at is not None:
                done = done.where(F.col("batch_id") > at).unionByName(all_.where(F.col("batch_id") == at))
        return done.groupBy("product_id").agg(F.max_by("balance", "batch_id").alias("opening"))

    def apply(self, deltas: DataFrame, batch_id: int) -> None:
        """The chunked ledger on one micro-batch, from the committed balances: a
        product that holds a third of it is split into chunks like any other."""
        spark, kind = deltas.sparkSession, deltas.schema["product_id"].dataType.simpleString()
        opening = self.balances(spark, kind, batch_id)
        if opening is not None:
            opening = opening.join(deltas.select("product_id").distinct(), "product_id", "left_semi")
        write_batch(LG.ledger(deltas, opening, default_opening=self.opening), f"{self.path}/rows", batch_id)
        own = spark.read.parquet(f"{self.path}/rows/batch_id={batch_id}")
        write_batch(LG.final_balances(own).select("product_id", "balance"), f"{self.path}/balances", batch_id)
        if (batch_id + 1) % self.compact_every == 0:
            after = self.balances(spark, kind, batch_id + 1).withColumnRenamed("opening", "balance")
            write_batch(after, f"{self.path}/snapshots", batch_id)


def stock_ledger_sink(path: str, opening: int = 300, compact_every: int = 16) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer of the streaming ledger: a micro-batch's deltas are applied
    in (ts, event_id) order from the balances that the batches before it left."""
    return LedgerStore(path, opening, compact_every).apply


# ------------------------------------------------------------------ T5
def low_stock_sink(path: str, thresholds: C.AlertThresholds = C.DEFAULT_THRESHOLDS, outbox: NT.Outbox | None = None):
    """foreachBatch writer: P12 + R1 on the micro-batch, without ids that earlier
    batches have stored (redelivered events alert once); new alerts go to the
    ``outbox`` if there is one."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ev = AL.downward_adjustments(batch).select(
            F.col("productId").cast("bigint").alias("product_id"), "sku",
            F.col("stockQuantity").alias("stock_quantity"),
            F.col("occurredAt").alias("occurred_at"), AL.stock_event_key().alias("event_key"))
        alerts = AL.low_stock(ev, thresholds, event_key="event_key").dropDuplicates(["id"]) \
            .withColumn("alert_date", F.to_date("occurred_at"))
        if path_exists(spark, path):
            # only the date partitions this batch touches are read (the semi
            # join on the partition column lets Spark prune the others)
            stored = spark.read.schema(alerts.schema.add("batch_id", "long")).parquet(path)
            existing = stored.where(F.col("batch_id") < batch_id).select("id", "alert_date") \
                .join(alerts.select("alert_date").distinct(), "alert_date", "left_semi")
            alerts = alerts.join(existing, ["id", "alert_date"], "left_anti")
        (alerts.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", "alert_date").parquet(path))
        if outbox is not None:
            own = spark.read.schema(alerts.schema.add("batch_id", "long")).parquet(path).where(F.col("batch_id") == batch_id)
            outbox.commit(own.drop("batch_id", "alert_date"), batch_id)
            outbox.deliver(spark)
    return write


# ------------------------------------------------------------------ T6
def results_of(forecast_events: DataFrame) -> DataFrame:
    """Forecast events (completed and failed) as results for the alert rules."""
    return forecast_events.where(F.col("eventType").isin("FORECAST_COMPLETED", "FORECAST_FAILED")).select(
        F.col("jobId").alias("job_id"), F.col("productId").cast("bigint").alias("product_id"), "sku", "status",
        F.col("totalPredictedDemand").alias("total_predicted_demand"),
        F.col("errorMessage").alias("error_message"), F.col("occurredAt").cast("timestamp_ntz").alias("occurred_at"))


def changes_of(product_events: DataFrame) -> DataFrame:
    """Stock adjustments as the changes of a stock index."""
    return product_events.where(F.col("eventType") == "STOCK_ADJUSTED").select(
        F.col("productId").cast("bigint").alias("product_id"), F.col("occurredAt").cast("timestamp_ntz").alias("ts"),
        F.col("eventSeq").alias("seq"), F.col("stockQuantity").cast("bigint").alias("stock"))


def forecast_alert_sink(path: str, index: StockIndex, thresholds: C.AlertThresholds = C.DEFAULT_THRESHOLDS,
                        outbox: NT.Outbox | None = None):
    """foreachBatch writer: forecast events raise surge, low-demand and failed alerts
    with the stock as of each event (J7), read from the days of ``index`` that the
    batch touches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        _raise_alerts(index.as_of(results_of(batch), LATEST), path, batch_id, thresholds, outbox)
    return write


def _raise_alerts(results: DataFrame, path: str, batch_id: int, thresholds: C.AlertThresholds, outbox: NT.Outbox | None) -> None:
    write_batch(AL.forecast_alerts(results, thresholds), path, batch_id)
    if outbox is not None:
        spark = results.sparkSession
        outbox.commit(spark.read.parquet(f"{path.rstrip('/')}/batch_id={batch_id}"), batch_id)
        outbox.deliver(spark)


# ------------------------------------------------------------------ T6 (both topics)
_CHANGE, _RESULT = ("ts", "seq", "stock"), ("job_id", "sku", "status", "total_predicted_demand", "error_message", "occurred_at")


def both_topics(product_events: DataFrame, forecast_events: DataFrame) -> DataFrame:
    """Stock changes and forecast results as one stream, told apart by ``is_change``."""
    changes, results = changes_of(product_events), results_of(forecast_events)
    null = lambda df, cols: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in cols]
    return changes.select(F.lit(True).alias("is_change"), "product_id", *_CHANGE, *null(results, _RESULT)).unionByName(
        results.select(F.lit(False).alias("is_change"), "product_id", *null(changes, _CHANGE), *_RESULT))


def indexed_alert_sink(path: str, index_path: str, retention_days: int = 7, thresholds: C.AlertThresholds = C.DEFAULT_THRESHOLDS,
                       default_stock: int = C.DEFAULT_CURRENT_STOCK, outbox: NT.Outbox | None = None):
    """foreachBatch writer of ``both_topics``: a batch's stock changes extend the
    stored index, then its forecasts are looked up as of their own time, however late
    they or the changes come. What is kept to look up is bounded by
    ``retention_days`` (see ``StockIndex``); forecasts from before are looked up in
    the stored history. A forecast is answered in the batch it comes in, from the
    changes stored by then; a change that comes after it does not alter its answer."""
    def write(batch: DataFrame, batch_id: int) -> None:
        index = StockIndex(batch.sparkSession, index_path, retention_days, default_stock)
        touched = index.extend(batch.where("is_change").select("product_id", *_CHANGE), batch_id)
        results = batch.where("NOT is_change").select("product_id", *_RESULT)
        _raise_alerts(index.as_of(results, batch_id, touched), path, batch_id, thresholds, outbox)
        index.fold(batch_id, touched)
    return write


# ------------------------------------------------------------------ T7
def order_forecast_sink(models_path: str, jobs_path: str, points_path: str, fit: Callable[[DataFrame], DataFrame],
                        rows: Callable[[DataFrame], tuple]):
    """foreachBatch writer: confirmed orders of the micro-batch become one forecast
    job per item (batch F4 plan). The batch is parsed and fitted once, into a written
    table of model rows; jobs and points are projections of that table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(fit(batch), models_path, batch_id)
        jobs, pts = rows(batch.sparkSession.read.parquet(f"{models_path.rstrip('/')}/batch_id={batch_id}"))
        write_batch(jobs, jobs_path, batch_id)
        write_batch(pts, points_path, batch_id)
    return write


# ------------------------------------------------------------------ S1..S3
def rejecting_sink(topic: str, sink: Callable[[DataFrame, int], None], rejected_path: str):
    """foreachBatch writer of raw keyed records: those that parse go to ``sink``, the
    others to a table of rejected records, a folder per batch. No record is lost in
    between: as many come in as are parsed and rejected."""
    def write(batch: DataFrame, batch_id: int) -> None:
        good, bad = EV.parse_records(batch, topic)
        write_batch(bad, rejected_path, batch_id)
        sink(good, batch_id)
    return write


# ------------------------------------------------------------------ T9
def dedup_sink(path: str, keys: Sequence[str], event_time: str = "ts"):
    """foreachBatch writer that keeps the first delivery of every event, however
    late it comes: a batch loses its own repeats and the keys already stored for
    the days it touches. A redelivered event has its event time again, so only
    those days are read. Each batch writes to a folder of its own below the day,
    which a retry replaces; stored batches with a higher number are not looked at,
    so a retry gives the same rows."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys)).withColumn("day", F.to_date(event_time))
        if path_exists(spark, path):
            schema = new.schema.add("batch_id", "long")
            stored = (spark.read.schema(schema).parquet(path).where(F.col("batch_id") < batch_id)
                      .join(new.select("day").distinct(), "day", "left_semi").select("day", *keys))
            new = new.join(stored, ["day", *keys], "left_anti")
        (new.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id", "day").parquet(path))
    return write


def daily_demand_sink(path: str):
    """foreachBatch writer of A7: each micro-batch adds its own sums per product
    and day (one folder per batch, replaced on a retry). No row is too late and
    no day stays open; ``daily_demand_total`` adds the parts up."""
    def write(batch: DataFrame, batch_id: int) -> None:
        part = (batch.groupBy("product_id", F.to_date("occurred_at").alias("ds"))
                .agg(F.sum(F.col("quantity").cast("double")).alias("y")))
        write_batch(part, path, batch_id)
    return write


def daily_demand_total(parts: DataFrame) -> DataFrame:
    return parts.groupBy("product_id", "ds").agg(F.sum("y").alias("y"))
