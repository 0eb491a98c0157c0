"""Forecast models kept up to date by a stream of items (T7 on A7).

``series`` (a bucket table) holds a row per product and day: the quantity, the day's
position and running sums up to it (Σy, Σxy, smallest y, and Σy and count per
weekday; Σx and Σx² follow from the position). The first 80 % of a series end at one
row of it, so a fit is that row, the last row, and the errors of the rows between.

A micro-batch adds its items to the days they fall on, in whatever order it comes:
only the buckets of the series it touches are summed anew and written, with their
models. Of the stored rows days and quantities alone are moved: the sums, many times
as wide, are made anew where their series lies. Each batch writes a version of its own
(see ``BucketTable``), so a batch that is tried again does not count its items twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.expr import round_even, weekday_mon0
from ..operators import forecast as FC
from ..sources.buckets import BucketTable

SUMS = ["sy double", "sxy double", "min_y double", *(f"dsum{i} double" for i in range(7)), *(f"dcnt{i} long" for i in range(7))]
SERIES = ", ".join(["product_id long", "ds date", "y double", "x long", *SUMS])
MODELS = ", ".join(["product_id long", "n long", "k long", "slope double", "intercept double", "last_ds date",
                    *(f"f{i} double" for i in range(7)), "mae double", "min_y double"])


def _names(spec: str | list[str]) -> list[str]:
    return [x.strip().split(" ")[0] for x in (spec.split(",") if isinstance(spec, str) else spec)]


#: what the rows of a series lie by (see ``BucketTable.dealt``)
SERIES_KEY = ("bucket", "part", "product_id")


def extended(table: BucketTable, stored: DataFrame, added: DataFrame) -> DataFrame:
    """Series rows, dealt out by ``table``, after quantities (product_id, ds, y) were
    added to ``stored``. Only days and quantities are moved, once; the sums are made
    where a series lies. Without a date are: a batch's row, which comes before its first
    day (or last, if it has none), and a stored row, which ends when its series changes."""
    old = stored.select("product_id", "ds", "y", "x", F.lit(False).alias("new"))
    new = added.select("product_id", "ds", "y", F.lit(None).cast("long").alias("x"), F.lit(True).alias("new"))
    undated = F.when(F.col("ds").isNull(), F.coalesce("x", F.lit(-1).cast("long")))
    rows = table.dealt(old.unionByName(new)).groupBy(*SERIES_KEY, "ds", undated.alias("undated")).agg(
        F.sum("y").alias("y"), F.max("x").alias("x"), F.max("new").alias("new"))
    series = Window.partitionBy(*SERIES_KEY)
    rows = rows.withColumn("first", F.min(F.when(F.col("new"), F.col("ds"))).over(series))
    rows = rows.withColumn("kept_to", F.max(F.when(F.col("ds") < F.col("first"), F.col("x"))).over(series))
    ends = F.col("ds").isNull() & ~F.col("new") & F.col("first").isNotNull()
    rows = rows.where(~ends | (F.col("x") < F.col("kept_to")))
    # rows before the first changed day in their stored order, then the changed ones by day
    stays = F.col("first").isNull() | F.col("ds").isNull() & ~F.col("new") | (F.col("ds") < F.col("first"))
    before = (Window.partitionBy(*SERIES_KEY).orderBy(F.when(stays, F.col("x")).asc_nulls_last(), F.col("ds").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("ends", ends).withColumn("x", F.count(F.lit(1)).over(before) - 1)
    dow = [weekday_mon0("ds") == i for i in range(7)]
    sums: list[Column] = [
        F.sum("y").over(before).alias("sy"),
        F.sum(F.col("x") * F.col("y")).over(before).alias("sxy"),
        F.min("y").over(before).alias("min_y"),
        *(F.sum(F.when(d, F.col("y")).otherwise(0.0)).over(before).alias(f"dsum{i}") for i, d in enumerate(dow)),
        *(F.count(F.when(d, 1)).over(before).alias(f"dcnt{i}") for i, d in enumerate(dow))]
    return rows.select(*SERIES_KEY, "ds", "y", "x", *sums, "ends").where(~F.col("ends")).drop("ends")


def models_of(series: DataFrame) -> DataFrame:
    """The model of every series that ``extended`` gives, as ``forecast.fit`` gives it,
    from the running sums: the training row's sums, then the validation errors. A series
    lies in one task, so none of its rows is moved."""
    whole = Window.partitionBy(*SERIES_KEY)
    rows = series.where(F.col("product_id").isNotNull()).withColumn("n", F.max("x").over(whole) + 1)
    rows = rows.withColumn("k", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * F.lit(C.TRAIN_FRACTION)).cast("long")))
    trained = F.col("x") == F.col("k") - 1
    kd = F.col("k").cast("double")
    sx, sxx = kd * (kd - 1) / 2, (kd - 1) * kd * (2 * kd - 1) / 6
    den = kd * sxx - sx * sx
    slope = F.when(den != 0, (kd * F.col("sxy") - sx * F.col("sy")) / den)
    rows = rows.withColumn("slope", F.max(F.when(trained, slope)).over(whole))
    rows = rows.withColumn("intercept", F.max(F.when(trained, (F.col("sy") - F.col("slope") * sx) / kd)).over(whole))
    mean = F.col("sy") / kd
    g = F.when(mean > 0, mean).otherwise(F.lit(1.0))
    factors = [F.coalesce(F.when(F.col(f"dcnt{i}") > 0, F.col(f"dsum{i}") / F.col(f"dcnt{i}")) / g, F.lit(1.0)) for i in range(7)]
    fitted = F.greatest(F.lit(0.0), F.col("slope") * F.col("x").cast("double") + F.col("intercept"))
    error = F.when(F.col("x") >= F.col("k"), F.abs(F.col("y") - fitted))
    models = rows.groupBy(*SERIES_KEY).agg(
        *(F.max(c).alias(c) for c in ("n", "k", "slope", "intercept")), F.max("ds").alias("last_ds"),
        *(F.max(F.when(trained, f)).alias(f"f{i}") for i, f in enumerate(factors)),
        F.coalesce(F.avg(error), F.lit(0.0)).alias("mae_raw"), F.min("y").alias("min_y"), F.max(trained).alias("trained"))
    return models.where("trained").withColumn("mae", round_even("mae_raw", 4)).select("bucket", *_names(MODELS))


class ForecastStore:
    """Series and models of all products, below one folder."""

    def __init__(self, spark, path: str, buckets: int = 64):
        self.series = BucketTable(spark, f"{path.rstrip('/')}/series", SERIES, "product_id", buckets)
        self.models = BucketTable(spark, f"{path.rstrip('/')}/models", MODELS, "product_id", buckets)

    def extend(self, items: DataFrame, version: int, ts: str = "occurred_at", qty: str = "quantity") -> list[int]:
        """Add a batch of items; the series and models in the buckets of its products
        are brought up to date. The touched buckets."""
        touched = self.series.touched(items.select(F.col("product_id").cast("long").alias("product_id")))
        rows = extended(self.series, self.series.read(version, touched), FC.daily_demand(items, ts=ts, qty=qty))
        self.series.write(rows, version, touched, dealt=True)
        # the models of the touched buckets, where their series lie: a series' own sums are not moved
        self.models.write(models_of(rows), version, touched, dealt=True)
        return touched

    def current(self, min_points: int = C.MIN_HISTORY) -> DataFrame:
        """The models that requests may use (long enough, no negative quantity)."""
        return self.models.read().where((F.col("n") >= min_points) & (F.col("min_y") >= 0))


def refresh_sink(path: str, buckets: int = 64, after: Callable[[ForecastStore, int], None] | None = None):
    """foreachBatch writer: a micro-batch of items (product_id, occurred_at, quantity)
    extends the stored series and refreshes the models of its products."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store = ForecastStore(batch.sparkSession, path, buckets)
        store.extend(batch, batch_id)
        if after is not None:
            after(store, batch_id)
    return write
