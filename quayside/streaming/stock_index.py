"""Stock as of a time, from stored changes that every micro-batch extends.

Below one folder of shared storage:

- ``history/day=D/batch_id=k``: every stock change, by its day.
- ``marks/day=D/batch_id=k``: per product the last change of the day (in batch k).
- ``base/batch_id=k``: per product the last change before a day, the horizon.
- ``state/batch_id=k``: a row with the newest day, the horizon and the base in use.

A lookup of a time on day D at or after the horizon reads the changes of D, the
marks of the days between horizon and D, and the base: the folders of those days
and no others (``tables_of``). ``fold`` moves the horizon on when the newest day
has left it more than ``retention_days`` behind: the marks that leave go into a new
base, so a product has at most a mark per day kept and one row in the base, however
long its history. Times before the horizon are looked up in the stored history up
to their day. Changes may come in any order; one that is older than the horizon goes
into the base as well.

A batch writes folders of its own number only and reads those of lower numbers and
its own, so a batch that is tried again ends in the same state. Equal instants are
told apart by sequence number (null: before all others).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..operators import alerts as AL

CHANGE = "product_id long, ts timestamp_ntz, seq long, stock long"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there; any other trouble with the store rises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: A batch number above all others: look-ups in everything that is stored.
LATEST = 1 << 62


class StockIndex:
    def __init__(self, spark: SparkSession, path: str, retention_days: int = 7, default: int | None = C.DEFAULT_CURRENT_STOCK):
        if retention_days < 1:
            raise ValueError("at least one day is kept")
        self.spark, self.path, self.retention, self.default = spark, path.rstrip("/"), retention_days, default

    # ---------------------------------------------------------------- stored tables
    def _folders(self, table: str) -> dict[dt.date, str]:
        """The day folders of a table, by one listing of its root."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return {dt.date.fromisoformat(n[len("day="):]): f"{self.path}/{table}/{n}" for n in names if n.startswith("day=")}

    def _read(self, table: str, days: Iterable[dt.date] | None, up_to: int) -> DataFrame | None:
        """Rows of the named days (all, if none are named): no file of another day is
        listed."""
        there = self._folders(table)
        paths = [there[d] for d in sorted(there if days is None else set(days) & set(there))]
        if not paths:
            return None
        rows = self.spark.read.schema(f"{CHANGE}, day date, batch_id long").option("basePath", f"{self.path}/{table}").parquet(*paths)
        return rows.where(F.col("batch_id") <= up_to)

    def state(self, before: int) -> tuple[dt.date | None, dt.date | None, int | None]:
        """(newest day, horizon, batch of the base) after the last batch before
        ``before``."""
        root = f"{self.path}/state"
        if not path_exists(self.spark, root):
            return None, None, None
        rows = self.spark.read.schema("newest date, horizon date, base long, batch_id long").parquet(root)
        last = rows.where(F.col("batch_id") < before).orderBy(F.desc("batch_id")).limit(1).collect()
        return (last[0]["newest"], last[0]["horizon"], last[0]["base"]) if last else (None, None, None)

    def _base(self, batch: int | None) -> DataFrame | None:
        return None if batch is None else self.spark.read.schema(CHANGE).parquet(f"{self.path}/base/batch_id={batch}")

    # ---------------------------------------------------------------- a micro-batch
    def extend(self, changes: DataFrame, batch_id: int) -> list[dt.date]:
        """Store the changes (columns of CHANGE) of a batch; the days they touch."""
        rows = changes.where(F.col("ts").isNotNull()).select("product_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
                                                             F.col("seq").cast("long").alias("seq"), F.col("stock").cast("long").alias("stock"))
        self._write(rows.withColumns({"day": F.to_date("ts"), "batch_id": F.lit(batch_id).cast("long")}), "history")
        touched = [d for d, p in self._folders("history").items() if path_exists(self.spark, f"{p}/batch_id={batch_id}")]
        if touched:
            own = self._read("history", touched, batch_id).where(F.col("batch_id") == batch_id)
            self._write(_last(own, "day").withColumn("batch_id", F.lit(batch_id).cast("long")), "marks")
        return sorted(touched)

    def _write(self, rows: DataFrame, table: str) -> None:
        # rows of one day come together first, so a day has few files per batch; adaptive
        # execution splits a day that is large
        (rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day", "batch_id").parquet(f"{self.path}/{table}"))

    def tables_of(self, days: list[dt.date], batch_id: int, touched: list[dt.date]) -> DataFrame | None:
        """The stored rows that decide lookups on ``days``, none of which lies
        before the horizon."""
        newest, horizon, base = self.state(batch_id)
        between = [d for d in self._folders("marks") if (horizon is None or d >= horizon) and d < max(days) and d not in days]
        return _union([self._read("history", days, batch_id), self._read("marks", between, batch_id), self._base(base),
                       self._late_marks(touched, horizon, batch_id)])

    def _late_marks(self, touched: list[dt.date], horizon: dt.date | None, batch_id: int) -> DataFrame | None:
        """This batch's marks of days before the horizon, which its base lacks."""
        marks = self._read("marks", [d for d in touched if horizon is not None and d < horizon], batch_id)
        return None if marks is None else marks.where(F.col("batch_id") == batch_id)

    def as_of(self, events: DataFrame, batch_id: int, touched: list[dt.date] | None = None, key: str = "product_id",
              t: str = "occurred_at") -> DataFrame:
        """``events`` with ``current_stock``: the stock at their time, from all
        changes stored by then (this batch's included), else the default."""
        day = F.to_date(t)
        days = [r[0] for r in events.where(F.col(t).isNotNull()).select(day.alias("d")).distinct().collect()]  # of one micro-batch
        horizon = self.state(batch_id)[1]
        recent = [d for d in days if horizon is None or d >= horizon]
        old = [d for d in days if d not in recent]
        out = [self._joined(events.where(F.col(t).isNull() | day.isin(recent)) if recent else events.where(F.col(t).isNull()),
                            self.tables_of(recent, batch_id, touched or []) if recent else None, key, t)]
        if old:
            history = self._read("history", [d for d in self._folders("history") if d <= max(old)], batch_id)
            out.append(self._joined(events.where(day.isin(old)), history, key, t))
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    def _joined(self, events: DataFrame, stock: DataFrame | None, key: str, t: str) -> DataFrame:
        if stock is None:
            return events.withColumn("current_stock", F.lit(self.default).cast("int"))
        stock = stock.select("product_id", "ts", F.coalesce("seq", F.lit(-1)).alias("seq"), "stock").withColumnRenamed("product_id", key)
        stock = stock.join(events.select(key).distinct(), key, "left_semi")
        return AL.stock_as_of(events, stock, key=key, t=t, stock_ts="ts", stock_seq="seq", stock_col="stock", default=self.default)

    def fold(self, batch_id: int, touched: list[dt.date]) -> None:
        """Move the horizon on after a batch and commit the batch's state."""
        newest, horizon, base = self.state(batch_id)
        newest = max([d for d in (newest, *touched) if d is not None], default=None)
        to = max([d for d in (horizon, newest and newest - dt.timedelta(days=self.retention)) if d is not None], default=None)
        leaving = [d for d in self._folders("marks") if to is not None and d < to and (horizon is None or d >= horizon)]
        parts = [self._read("marks", leaving, batch_id), self._late_marks(touched, horizon, batch_id)]
        if any(p is not None for p in parts):
            _last(_union([self._base(base), *parts])).write.mode("overwrite").parquet(f"{self.path}/base/batch_id={batch_id}")
            base = batch_id
        row = self.spark.createDataFrame([(newest, to, base)], "newest date, horizon date, base long")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state/batch_id={batch_id}")


def _union(parts: list[DataFrame | None]) -> DataFrame | None:
    rows = [p.select("product_id", "ts", "seq", "stock") for p in parts if p is not None]
    out = rows[0] if rows else None
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _last(changes: DataFrame, *within: str) -> DataFrame:
    """The last change per product (and ``within``), reduced before the shuffle."""
    place = F.struct("ts", F.coalesce("seq", F.lit(-1)).alias("s"))
    last = F.max_by(F.struct("ts", "seq", "stock"), place).alias("l")
    return changes.groupBy("product_id", *within).agg(last).select("product_id", "l.ts", "l.seq", "l.stock", *within)
