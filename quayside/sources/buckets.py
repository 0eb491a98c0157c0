"""Stored tables of which a write replaces the touched buckets only.

Rows lie in ``data/v=V/bucket=B`` by a hash of their key. ``versions/v=V`` is the
list of a version: which folder holds each bucket. A write names the buckets it
touches, writes those below its own version number, and its list links every other
bucket to the folder that held it before. Readers take one list and the folders it
names, so they see a version as a whole, and no older data is moved or copied.

A version number is the caller's (a micro-batch's, say). Writing one again replaces
it, and it starts from the last version below it, so a write that is tried again ends
as if it had been tried once. The driver handles bucket numbers only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _numbers(self, folder: str, name: str) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(x.partition("=")[2]) for x in found if x.startswith(f"{name}="))

    def version(self, before: int | None = None) -> int | None:
        """The last version (below ``before``)."""
        there = [v for v in self._numbers(f"{self.path}/versions", "v") if before is None or v < before]
        return there[-1] if there else None

    def places(self, version: int | None) -> dict[int, int]:
        """The version folder of every bucket that holds rows."""
        if version is None:
            return {}
        rows = self.spark.read.schema("bucket int, v int").parquet(f"{self.path}/versions/v={version}").collect()  # a row per bucket
        return {r["bucket"]: r["v"] for r in rows}

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the last version (below ``before``), of all buckets or the
        named ones: no file of another bucket is listed."""
        places = self.places(self.version(before))
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(places.items()) if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame, key: str | None = None) -> list[int]:
        """The buckets of the keys in ``rows``, at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket(F.col(key or self.key)).alias("b")).distinct().collect())

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows dealt out by ``bucket`` and ``part``, a share of its keys: what is grouped
        by these two and the key, and then written, is not moved again. The count is
        given: adaptive execution would choose one by the rows' packed size before they
        are sorted and widened."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("bucket", self.bucket(F.col(self.key))).withColumn("part", F.pmod(F.hash(self.key), F.lit(-(-2 * n // self.buckets))))
        return rows.repartition(n, "bucket", "part")

    def write(self, rows: DataFrame, version: int, touched: list[int] | None = None, dealt: bool = False) -> None:
        """Make ``rows`` the content of the touched buckets (all, if none are named)
        from ``version`` on. Rows of other buckets must not be among them. ``dealt``:
        they lie as ``dealt`` leaves them, with its ``bucket``, and are written there."""
        old = self.places(self.version(version))
        if dealt:
            rows = rows.select(*self.schema.names, "bucket")
        else:
            # a file per bucket, and several for a large one: adaptive execution splits it
            rows = rows.select(*self.schema.names).withColumn("bucket", self.bucket(F.col(self.key))).hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        own = {b: version for b in self._numbers(f"{self.path}/data/v={version}", "bucket")}
        if touched is not None and not set(own) <= set(touched):
            raise ValueError(f"rows of buckets that were not named: {sorted(set(own) - set(touched))}")
        kept = {} if touched is None else {b: v for b, v in old.items() if b not in touched}
        (self.spark.createDataFrame(sorted({**kept, **own}.items()), "bucket int, v int").coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/versions/v={version}"))

    def update(self, version: int, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], key: str | None = None) -> list[int]:
        """``merge(stored, incoming)`` on the buckets that ``incoming`` touches, as a
        new version; those buckets."""
        touched = self.touched(incoming, key)
        self.write(merge(self.read(version, touched), incoming), version, touched)
        return touched
