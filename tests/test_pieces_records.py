"""Large orders in pieces; records that do not parse."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quayside.operators import reads as RD
from quayside.sources import events as EV
from quayside.streaming import jobs as SJ

T0 = dt.datetime(2024, 1, 1)
ITEMS = "order_id long, product_id long, sku string, quantity int, unit_price decimal(12,2)"


@pytest.fixture(scope="module")
def shop(spark):
    """Order 0 holds most items; order 5 has none; one item names no order."""
    orders = spark.createDataFrame([(k, 100 + k, "PENDING") for k in range(6)], "id long, customer_id long, status string")
    rows = [(0, k, f"S{k}", 1 + k % 3, Decimal("1.50")) for k in range(300)] + [(0, 1, "S1", 2, Decimal("1.50"))] * 2
    rows += [(k, k, f"S{k}", 2, Decimal("3.00")) for k in range(1, 5) for _ in range(k)] + [(99, 1, "S", 1, Decimal("1"))]
    return orders, spark.createDataFrame(rows, ITEMS), rows


@pytest.mark.parametrize("limit", [10_000, 40, 1])
def test_flat_views_do_not_depend_on_pieces(shop, limit):
    orders, items, rows = shop
    flat = sorted(tuple(r) for r in RD.order_view_flat(orders, items, limit).select(
        "id", "customer_id", "product_id", "quantity", "subtotal", "total").collect() if r.product_id is not None)
    totals = {k: sum(r[3] * r[4] for r in rows if r[0] == k) for k in range(6)}
    assert flat == sorted((r[0], 100 + r[0], r[1], r[3], r[3] * r[4], totals[r[0]]) for r in rows if r[0] < 6)
    (none,) = RD.order_view_flat(orders, items, limit).where("product_id IS NULL").collect()
    assert (none.id, none.total, none.subtotal) == (5, Decimal("0.00"), None)
    joined = RD.orders_with_items(orders, items, limit)
    assert joined.columns == ["id", "customer_id", "status", "product_id", "sku", "quantity", "unit_price"]
    assert sorted(((r.id, r.product_id) for r in joined.collect()), key=str) == sorted(
        [*((r[0], r[1]) for r in rows if r[0] < 6), (5, None)], key=str)


def test_a_large_order_is_dealt_out_in_pieces(shop):
    orders, items, rows = shop
    v = RD.order_view(orders, items, 40).collect()
    hot = [r for r in v if r.id == 0]
    assert len(hot) == 8 and {r.n_pieces for r in hot} == {8} and {r.piece for r in hot} == set(range(8))
    assert max(len(r["items"]) for r in hot) <= 80 and sum(len(r["items"]) for r in hot) == 302
    assert len({r.total for r in hot}) == 1 and hot[0].total == sum(r[3] * r[4] for r in rows if r[0] == 0)
    assert sorted((r.id, len(r["items"]), r.n_pieces) for r in v if r.id) == [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 0, 1)]


def test_pieces_are_the_key_of_group_and_join(spark, shop):
    """No exchange of items is by the order alone, but the one that meets the table of
    large orders, whose sides adaptive execution can split."""
    orders, items, _ = shop
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = RD.order_view(orders, items, 40)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(order_id" in p and p.count("collect_list") >= 2
    group = next(x for x in p.splitlines() if "ObjectHashAggregate(keys=[order_id" in x)
    assert "piece" in group.split("functions")[0]


def test_order_events_name_their_piece_only_where_there_are_several(spark):
    ev = spark.createDataFrame(
        [("ORDER_PLACED", 1, 7, [], Decimal("1"), "PENDING", T0, 0, 1), ("ORDER_PLACED", 2, 7, [], Decimal("1"), "PENDING", T0, 1, 3)],
        "eventType string, orderId long, customerId long, items array<struct<productId:string,sku:string,quantity:int,unitPrice:decimal(12,2)>>, "
        "total decimal(18,2), status string, occurredAt timestamp, piece int, n_pieces int")
    rec = EV.order_event_records(ev)
    one, two = (json.loads(r.value) for r in rec.orderBy("key").collect())
    assert "piece" not in one and (two["piece"], two["pieces"]) == (1, 3)
    got = EV.parse_values(rec, "order.events").orderBy("orderId").collect()
    assert [(r.piece, r.pieces) for r in got] == [(None, None), (1, 3)]


GOOD = '{"eventType":"STOCK_ADJUSTED","productId":"1","stockQuantity":4,"occurredAt":"2024-01-01T00:00:00Z","unknown":1}'
RECORDS = [("a", GOOD), ("b", '{"eventType":"STOCK_ADJ'), ("c", None), ("d", "null"), ("e", GOOD.replace(":4", ':"many"')), ("f", ""),
           ("g", "{}"), ("h", "[1]"), ("i", GOOD + "x"), (None, GOOD), ("j", "plain text")]


def test_every_record_is_parsed_or_rejected(spark):
    df = spark.createDataFrame(RECORDS, "key string, value string")
    good, bad = EV.parse_records(df, "product.events")
    assert good.count() + bad.count() == len(RECORDS)
    rejected = {r.key: (r.value, r.topic, r.reason) for r in bad.collect()}
    assert rejected["b"] == ('{"eventType":"STOCK_ADJ', "product.events", "does not parse")
    assert rejected["c"][2] == "no value" and {"b", "c", "d", "e", "f", "j"} <= rejected.keys()
    assert not {"a", None, "g"} & rejected.keys()
    assert [r.stockQuantity for r in good.where("productId = '1'").collect()][:2] == [4, 4]


def test_a_stream_keeps_what_it_rejects(spark, tmp_path):
    lines = [json.dumps({"key": k, "value": v}) for k, v in RECORDS] + ['{"key":"cut', json.dumps({"key": "z", "value": GOOD})]
    for k in range(3):
        (tmp_path / "topic").mkdir(exist_ok=True)
        (tmp_path / "topic" / f"{k}.json").write_text("\n".join(lines[k::3]) + "\n")
    run = str(tmp_path / "run")
    sink = SJ.rejecting_sink("product.events", lambda good, k: SJ.write_batch(good, run + "/good", k), run + "/bad")
    src = EV.keyed_records(spark, str(tmp_path / "topic"), stream=True, max_files_per_trigger=1)
    SJ.run_available_now(src, run + "/ckpt", sink=sink)
    good, bad = spark.read.parquet(run + "/good"), spark.read.parquet(run + "/bad")
    assert good.count() + bad.count() == len(lines)
    assert bad.where(F.col("value") == '{"key":"cut').count() == 1 and good.where("stockQuantity = 4").count() >= 3
    # the reader that only wants what parses leaves the same records out
    assert EV.read_keyed_topic(spark, str(tmp_path / "topic"), "product.events").count() == good.count()
