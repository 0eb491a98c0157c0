"""The order topic and the stores of the stream that forecasts orders."""

import glob
import gzip
import json
import re

from quayside.operators import reads as RD
from quayside.plans import catalog as CA
from quayside.sources import events as EV
from quayside.streaming import jobs as SJ

BASE = "/root/testdata/sf0.001"


def test_a_topic_may_be_gzipped_and_dealt_before_its_records_are_made(spark, tmp_path):
    rows = [(f"k{k % 5}", f'{{"eventType":"E{k}"}}', k) for k in range(40)]
    rec = spark.createDataFrame(rows, "key string, value string, _order_seq long").repartition(3, "key")
    EV.write_topic(rec, str(tmp_path / "t"), ("_order_seq",), compression="gzip", dealt=True)
    files = glob.glob(f"{tmp_path}/t/*.json.gz")
    met = {}
    for f in files:
        for line in gzip.open(f, "rt"):
            r = json.loads(line)
            met.setdefault(r["key"], []).append((f, int(re.search("E([0-9]+)", r["value"])[1])))
    assert len(files) > 1 and len(met) == 5
    for got in met.values():  # a key in one file, in order
        assert len({f for f, _ in got}) == 1 and [k for _, k in got] == sorted(k for _, k in got) and len(got) == 8
    back = EV.keyed_records(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted((k, v) for k, v, _ in rows)


def test_events_of_orders_dealt_out_are_the_same(spark):
    a, b = (EV.order_event_records(CA.order_events(spark, BASE, by_order=o)) for o in (False, True))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


def test_an_order_view_moves_its_items_once(spark):
    items = spark.createDataFrame([(1, 7, "S", 2, 3)], "order_id long, product_id long, sku string, quantity int, unit_price int")
    items = items.selectExpr("order_id", "product_id", "sku", "quantity", "cast(unit_price AS decimal(12,2)) AS unit_price")
    orders = spark.createDataFrame([(1, 5), (2, 6)], "id long, customer_id long")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        v = RD.order_view(orders, items)
        p = v._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    # the bare items by (order, piece), before arrays are made, and the headers
    assert [k for k in re.findall(r"Exchange hashpartitioning\(order_id#\d+L?, piece#\d+L?, \d+\), (\w+)", p)] == ["ENSURE_REQUIREMENTS", "REPARTITION_BY_COL"]
    assert p.index("collect_list") < p.index("REPARTITION_BY_COL")
    got = {r.id: r for r in v.collect()}
    assert [i.sku for i in got[1]["items"]] == ["S"] and got[2]["items"] == []


def test_batches_of_a_stream_are_stored_as_zstd(spark, tmp_path):
    """Jobs hold an id of 64 characters each, points repeat their job's keys."""
    df = spark.createDataFrame([(k, "x") for k in range(10)], "a long, b string")
    SJ.write_batch(df, str(tmp_path / "jobs"), 3)
    assert glob.glob(f"{tmp_path}/jobs/batch_id=3/*.zstd.parquet") and not glob.glob(f"{tmp_path}/jobs/batch_id=3/*.snappy.parquet")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "jobs")).select("a", "b").collect())) == [(k, "x") for k in range(10)]
