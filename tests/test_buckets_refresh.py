"""Bucket tables and models refreshed from running sums."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.operators import forecast as FC
from quayside.sources import store as ST
from quayside.sources.buckets import BucketTable
from quayside.streaming import jobs as SJ
from quayside.streaming import refresh as RF

T0 = dt.datetime(2024, 1, 1)
PRODUCTS = ("product_id long, name string, sku string, category string, price decimal(12,2), stock_quantity int, "
            "created_at timestamp, updated_at timestamp, version long")


def products(spark, ids, name="old", version=0):
    return spark.range(0).sparkSession.createDataFrame(
        [(i, name, f"S{i}", "c", None, 1, T0, T0 + dt.timedelta(days=version), version) for i in ids], PRODUCTS)


def test_an_upsert_writes_the_touched_buckets_only(spark, tmp_path):
    """1 % changed ids: as many buckets are written as the ids fall into, and the
    result is that of the upsert on the whole table."""
    t = BucketTable(spark, str(tmp_path / "p"), PRODUCTS, "product_id", 64)
    stored = products(spark, range(1000))
    t.write(stored, 0)
    incoming = products(spark, [*range(0, 1000, 200), 5000, 5001], "new", 3).drop("version")
    touched = t.update(1, incoming, ST.upsert_products)
    assert 1 <= len(touched) <= 7
    assert sorted(os.listdir(tmp_path / "p/data/v=1"))[-len(touched):] == sorted(f"bucket={b}" for b in touched)
    got = sorted(map(tuple, t.read().collect()))
    assert got == sorted(map(tuple, ST.upsert_products(stored, incoming).collect())) and len(got) == 1002
    places = t.places(1)
    assert {b for b, v in places.items() if v == 1} == set(touched) and len(places) == 64
    # a write tried again starts from the version below it
    t.update(1, incoming, ST.upsert_products)
    assert sorted(map(tuple, t.read().collect())) == got
    # one file listing per named bucket
    assert {f.split("bucket=")[1].split("/")[0] for f in t.read(2, touched[:1]).inputFiles()} == {str(touched[0])}
    # the version below is still whole
    assert sorted(map(tuple, t.read(before=1).collect())) == sorted(map(tuple, stored.collect()))


def test_bucket_tables_that_empty_out(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "p"), "k long, v string", "k", 4)
    assert t.read().count() == 0 and t.version() is None
    rows = spark.createDataFrame([(k, "a") for k in range(20)] + [(None, "n")], "k long, v string")
    t.write(rows, 0)
    assert t.read().count() == 21
    touched = t.update(1, rows.where("k < 3"), lambda old, new: old.join(new, "k", "left_anti"))
    assert t.read().count() == 18 and t.touched(rows.where("k IS NULL")) == t.touched(rows.where("k IS NULL"))
    t.write(rows.limit(0), 2)
    assert t.read().count() == 0 and t.places(2) == {}
    with pytest.raises(ValueError):
        t.write(rows, 3, touched[:1] if len(touched) < 4 else [0])


def batch_fit(items):
    m = FC.fit(FC.daily_demand(items), ["product_id"])
    return {r.product_id: r.asDict() for r in m.collect()}


def test_models_after_every_trigger_equal_the_batch_fit(spark, tmp_path):
    """Days in order, late days, more quantity on old days, new products and
    negative quantities, over five triggers."""
    rng = np.random.default_rng(2)
    rows = [(int(p), T0 + dt.timedelta(days=int(d), hours=int(h)), int(q)) for p, d, h, q in
            zip(rng.integers(0, 7, 500), np.sort(rng.integers(0, 70, 500)) + rng.integers(-4, 4, 500), rng.integers(0, 24, 500), rng.integers(-1, 9, 500))]
    rows[0] = (77, T0, 3)  # a series of one day
    schema, src = "product_id long, occurred_at timestamp, quantity int", tmp_path / "src"
    for k in range(5):
        spark.createDataFrame(rows[k * 100:(k + 1) * 100], schema).coalesce(1).write.parquet(str(src / f"p={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    seen = []

    def compare(store, batch_id):
        if batch_id == 2:  # tried again: nothing is counted twice
            store.extend(spark.createDataFrame(rows[200:300], schema), batch_id)
        want = batch_fit(spark.createDataFrame(rows[:(batch_id + 1) * 100], schema))
        got = {r.product_id: r.asDict() for r in store.models.read().collect()}
        assert got.keys() == want.keys()
        for p in want:
            assert got[p] == pytest.approx(want[p], abs=1e-9), (batch_id, p)
        seen.append(batch_id)

    SJ.run_available_now(stream, str(tmp_path / "ckpt"), sink=RF.refresh_sink(str(tmp_path / "store"), 8, after=compare))
    assert seen == [0, 1, 2, 3, 4]


def test_a_batch_extends_only_the_series_it_touches(spark, tmp_path):
    store = RF.ForecastStore(spark, str(tmp_path / "s"), buckets=32)
    items = spark.range(0, 40 * 30).select((F.col("id") % 40).alias("product_id"), F.lit(2).alias("quantity"),
                                           F.timestamp_seconds(1704067200 + F.floor(F.col("id") / 40) * 86400).alias("occurred_at"))
    store.extend(items, 0)
    touched = store.extend(items.where("product_id = 3").limit(1).withColumn("occurred_at", F.lit(T0 + dt.timedelta(days=29))), 1)
    assert len(touched) == 1
    assert [x for x in os.listdir(tmp_path / "s/series/data/v=1") if "=" in x] == [f"bucket={touched[0]}"]
    # rows before the changed day are the stored ones; the last day has the sums of both batches
    last = store.series.read().where("product_id = 3").orderBy(F.desc("ds")).first()
    assert (last.x, last.y, last.sy) == (29, 4.0, 62.0)
    # an empty batch changes nothing
    assert store.extend(items.limit(0), 2) == []
    assert store.models.read().count() == 40


def test_upsert_of_forecast_points_into_buckets(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "pts"), "job_id string, forecast_date date, q int", "job_id", 8)
    t.write(spark.createDataFrame([("a", T0.date(), 1), ("b", T0.date(), 1)], t.schema), 0)
    jobs = spark.createDataFrame([("a", "m", T0)], "id string, model_used string, updated_at timestamp")
    new = spark.createDataFrame([("a", T0.date(), 9)], t.schema)
    t.update(1, new, lambda stored, incoming: ST.replace_points(stored, jobs, incoming), key="job_id")
    assert sorted((r.job_id, r.q) for r in t.read().collect()) == [("a", 9), ("b", 1)]


def test_orders_and_jobs_are_written_into_touched_buckets(spark, tmp_path):
    oschema = "id long, customer_id long, status string, created_at timestamp, updated_at timestamp, version long"
    ischema = "order_id long, product_id long, quantity int"
    orders, items = BucketTable(spark, str(tmp_path / "o"), oschema, "id", 32), BucketTable(spark, str(tmp_path / "i"), ischema, "order_id", 32)
    stored = spark.createDataFrame([(k, 1, "PENDING", T0, T0, 0) for k in range(200)], oschema)
    stored_items = spark.createDataFrame([(k, p, 1) for k in range(200) for p in (1, 2)], ischema)
    orders.write(stored, 0)
    items.write(stored_items, 0)
    later = T0 + dt.timedelta(days=1)
    incoming = spark.createDataFrame([(3, 1, "SHIPPED", T0, later), (900, 2, "PENDING", T0, later)], "id long, customer_id long, status string, created_at timestamp, updated_at timestamp")
    new_items = spark.createDataFrame([(3, 9, 5), (900, 9, 6)], ischema)
    touched = ST.upsert_orders_into(orders, items, incoming, new_items, 1)
    assert len(touched) <= 2
    want_o, want_i = ST.upsert_orders(stored, stored_items, incoming, new_items)
    assert sorted(map(tuple, orders.read().collect())) == sorted(map(tuple, want_o.collect()))
    assert sorted(map(tuple, items.read().collect())) == sorted(map(tuple, want_i.collect()))
    assert {v for b, v in items.places(1).items() if b not in touched} == {0}

    jschema = ("id string, product_id long, sku string, horizon_days int, status string, model_used string, mae decimal(10,4), "
               "error_message string, created_at timestamp, updated_at timestamp, version long")
    jobs, points = BucketTable(spark, str(tmp_path / "j"), jschema, "id", 16), BucketTable(spark, str(tmp_path / "p"), "job_id string, q int", "job_id", 16)
    stored = spark.createDataFrame([(f"j{k}", k, "S", 30, "RUNNING", None, None, None, T0, T0, 0) for k in range(60)], jschema)
    jobs.write(stored, 0)
    points.write(spark.createDataFrame([(f"j{k}", 1) for k in range(60)], "job_id string, q int"), 0)
    done = stored.where("id = 'j7'").drop("version").withColumns({"status": F.lit("COMPLETED"), "model_used": F.lit("m"), "updated_at": F.lit(later)})
    touched = ST.upsert_jobs_into(jobs, points, done, spark.createDataFrame([("j7", 8), ("j7", 9)], "job_id string, q int"), 1)
    assert len(touched) == 1
    assert [(r.status, r.model_used, r.version) for r in jobs.read().where("id = 'j7'").collect()] == [("COMPLETED", "m", 1)]
    assert sorted(r.q for r in points.read().where("job_id = 'j7'").collect()) == [8, 9] and points.read().count() == 61
    with pytest.raises(ValueError):
        ST.upsert_orders_into(orders, BucketTable(spark, str(tmp_path / "x"), ischema, "order_id", 8), incoming, new_items, 2)


def test_series_and_models_are_made_where_a_series_lies(spark, tmp_path):
    """Days and quantities are moved, by day and to their series; neither the sums
    nor the models are, and every file holds one bucket's rows (F30)."""
    store = RF.ForecastStore(spark, str(tmp_path / "s"), buckets=4)
    items = spark.range(0, 40 * 30).select((F.col("id") % 40).alias("product_id"), F.lit(2).alias("quantity"),
                                           F.timestamp_seconds(1704067200 + F.floor(F.col("id") / 40) * 86400).alias("occurred_at"))
    store.extend(items, 0)
    rows = RF.extended(store.series, store.series.read(1), FC.daily_demand(items))
    for df in (rows, RF.models_of(rows)):
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        moved = [x for x in final.splitlines() if "Exchange " in x and "Reused" not in x]
        assert len(moved) == 2 and "SortMergeJoin" not in final and "BroadcastExchange" not in final, final
    assert store.extend(items, 1) == store.extend(items, 2)
    stored = store.series.read()
    assert {r.sy for r in stored.where("x = 29").collect()} == {30 * 6.0} and stored.count() == 40 * 30
    by_file = stored.select(F.input_file_name().alias("f"), store.series.bucket(F.col("product_id")).alias("b")).distinct().collect()
    assert all(f"bucket={r.b}/" in r.f for r in by_file)


def test_rows_without_a_date_end_when_their_series_changes(spark, tmp_path):
    store = RF.ForecastStore(spark, str(tmp_path / "s"), buckets=2)
    schema = "product_id long, occurred_at timestamp, quantity int"
    day = lambda k: T0 + dt.timedelta(days=k)
    store.extend(spark.createDataFrame([(1, None, 5), (1, day(1), 1), (1, day(2), 2), (2, None, 4), (2, day(3), 1), (None, day(0), 3)], schema), 0)
    assert sorted((r.x, r.sy) for r in store.series.read().where("product_id = 1").collect()) == [(0, 5.0), (1, 6.0), (2, 8.0)]
    store.extend(spark.createDataFrame([(1, day(2), 7), (1, None, 9), (2, None, 6)], schema), 1)
    got = sorted((r.product_id, r.x, r.ds and r.ds.day, r.y, r.sy) for r in store.series.read().where("product_id IS NOT NULL").collect())
    # product 1: its stored row is counted by the rows before the change and ends itself; the batch's comes before its first day
    assert got == [(1, 1, 2, 1.0, 6.0), (1, 2, None, 9.0, 15.0), (1, 3, 3, 9.0, 24.0),
                   (2, 0, None, 4.0, 4.0), (2, 1, 4, 1.0, 5.0), (2, 2, None, 6.0, 11.0)]
    assert sorted(r.product_id for r in store.models.read().collect()) == [1, 2]
