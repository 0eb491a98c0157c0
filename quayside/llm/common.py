"""Helpers shared by the operators: written tables, ranks, bounded samples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayside.session import ensure_checkpoint_dir

# The white space that separates words, as a regex class body,
# and the characters a word is made of.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: the
    lineage ends there, several branches read one computation, and a lost
    executor costs a re-read instead of a replay."""
    path = shared_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def done_with(*tables: DataFrame) -> None:
    """Remove the folders of written tables that nothing will read again: whatever
    was made of them must be written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.folder)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays as it is."""
    return F.translate(col, UPPER, LOWER)


def rank_within(df: DataFrame, keys: list[str], id_col: str, rank: str = "rank",
                seed: int = 0, splits: int = 256, ties: str | None = None) -> DataFrame:
    """Number the rows of every key 0, 1, 2, ... in a seeded order.

    A key may hold a third of all rows, so no window spans a whole key: rows go
    to ``splits`` parts of their key by a seeded hash of ``id_col``, each part is
    numbered on its own, and the parts' starts come from a running sum over the
    (key, part) counts. ``keys`` must be non-null columns; ``df`` is read twice,
    so hand in a written table. Rows equal in ``id_col`` take neighbouring ranks,
    in the order of ``ties`` if given.
    """
    h, part, first = "__hash", "__part", "__first"
    d = (df.withColumn(h, F.xxhash64(F.lit(seed), F.col(id_col)))
         .withColumn(part, F.pmod(F.col(h), F.lit(splits)).cast("int")))
    before = (Window.partitionBy(*keys).orderBy(part)
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = (d.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("__n"))
              .withColumn(first, F.coalesce(F.sum("__n").over(before), F.lit(0)))
              .drop("__n"))
    inside = Window.partitionBy(*keys, part).orderBy(h, id_col, *([ties] if ties else []))
    numbered = d.withColumn("__row", F.row_number().over(inside))
    return (numbered.join(starts, [*keys, part])
            .withColumn(rank, (F.col(first) + F.col("__row") - 1).cast("long"))
            .drop(h, part, first, "__row"))


def hash_sample(df: DataFrame, id_col: str, rows: int, seed: int = 0) -> DataFrame:
    """About ``rows`` rows (all, if there are fewer), chosen by a seeded hash of
    ``id_col`` so that reruns agree. Used only where a sample is the feature:
    cost estimates of the rule cascade and the fit of a classifier."""
    total = df.count()
    if total <= rows:
        return df
    share = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30))
    return df.where(share < F.lit(int((1 << 30) * rows / total)))


def summed_tables(rows: DataFrame) -> dict[str, np.ndarray]:
    """Add up tables of 64-bit counts by ``key`` (columns key, counts). Each key's
    tables are added in a stream, so a task holds one table per key, and one per
    key comes back; keys are few and tables of fixed size by the caller's bound."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(data, np.int64)
                sums[key] = sums[key] + c if key in sums else c
        yield pa.RecordBatch.from_pydict({"key": pa.array(list(sums), pa.string()),
                                          "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())})

    schema = "key string, counts binary"
    return {r["key"]: np.frombuffer(r["counts"], np.int64) for r in rows.repartition("key").mapInArrow(add, schema).collect()}
