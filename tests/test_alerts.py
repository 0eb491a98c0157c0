"""Alert rules, the as-of stock lookup, notification renderings and reads."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quayside.operators import alerts as AL
from quayside.operators import reads as RD

T0 = dt.datetime(2024, 1, 1, 12)


@pytest.mark.parametrize("stock,severity", [(11, None), (10, "WARNING"), (3, "WARNING"), (0, "CRITICAL")])
def test_low_stock(spark, stock, severity):
    ev = spark.createDataFrame([(1, "SKU-001", stock, T0, 7)],
                               "product_id long, sku string, stock_quantity int, occurred_at timestamp, event_id long")
    out = AL.low_stock(ev).collect()
    if severity is None:
        assert out == []
    else:
        (a,) = out
        assert (a.type, a.severity, a.title) == ("LOW_STOCK", severity, "Low Stock Alert: SKU-001")
        assert a.message == f"Product SKU-001 has only {stock} units remaining (threshold: 10)."


def results(spark, rows):
    return spark.createDataFrame(
        [(i, 1, "SKU-001", st, None if t is None else Decimal(str(t)), s, err, T0)
         for i, (t, s, st, err) in enumerate(rows)],
        "job_id long, product_id long, sku string, status string, total_predicted_demand decimal(18,2), "
        "current_stock int, error_message string, occurred_at timestamp")


@pytest.mark.parametrize("total,stock,types", [
    (150, 100, set()), (101, 50, {"DEMAND_SURGE"}), (3, 100, {"LOW_DEMAND_FORECAST"}),
    (3, 1, {"DEMAND_SURGE", "LOW_DEMAND_FORECAST"}),
])
def test_forecast_rules(spark, total, stock, types):
    r = results(spark, [(total, stock, "COMPLETED", None)])
    got = {a.type: a for a in AL.forecast_alerts(r).collect()}
    assert set(got) == types
    if "DEMAND_SURGE" in got:
        a = got["DEMAND_SURGE"]
        assert a.severity == "CRITICAL"
        assert a.message == (f"Forecast predicts {total} units demand over next 30 days, but current stock is "
                             f"only {stock} units (surge threshold: {stock * 2}). Restock urgently.")
    if "LOW_DEMAND_FORECAST" in got:
        assert got["LOW_DEMAND_FORECAST"].severity == "INFO"
    # the rule-by-rule operators agree with the one-pass union
    split = {a.type for a in AL.all_alerts(AL.demand_surge(r), AL.low_demand(r)).collect()}
    assert split == types


def test_failed_forecast_and_ignored_null_total(spark):
    r = results(spark, [(None, 100, "FAILED", "ML service down"), (None, 100, "COMPLETED", None)])
    (a,) = AL.forecast_alerts(r).collect()
    assert (a.type, a.severity) == ("FORECAST_FAILED", "WARNING")
    assert "ML service down" in a.message and a.message == "Demand forecast for SKU-001 failed: ML service down"


def test_percent_zero_f_rounds_half_up(spark):
    r = results(spark, [(Decimal("200.50"), 100, "COMPLETED", None)])
    (a,) = AL.forecast_alerts(r).collect()
    assert a.message.startswith("Forecast predicts 201 units")


def test_alert_ids_are_deterministic(spark):
    r = results(spark, [(3, 1, "COMPLETED", None)])
    assert sorted(x.id for x in AL.forecast_alerts(r).collect()) == \
        sorted(x.id for x in AL.forecast_alerts(r).collect())


def test_stock_as_of(spark):
    stock = spark.createDataFrame([
        (1, dt.datetime(2024, 1, 1, 8), 1, 50), (1, dt.datetime(2024, 1, 1, 12), 2, 40),
        (1, dt.datetime(2024, 1, 3, 9), 3, 30), (2, dt.datetime(2024, 1, 5), 4, 9)],
        "product_id long, ts timestamp, event_id long, balance long")
    ev = spark.createDataFrame([
        (1, dt.datetime(2024, 1, 1, 7)), (1, dt.datetime(2024, 1, 1, 12)), (1, dt.datetime(2024, 1, 2)),
        (1, dt.datetime(2024, 1, 9)), (2, dt.datetime(2024, 1, 4)), (3, dt.datetime(2024, 1, 4))],
        "product_id long, occurred_at timestamp")
    got = {(r.product_id, r.occurred_at): r.current_stock for r in AL.stock_as_of(ev, stock).collect()}
    assert got == {(1, dt.datetime(2024, 1, 1, 7)): 100, (1, dt.datetime(2024, 1, 1, 12)): 40,
                   (1, dt.datetime(2024, 1, 2)): 40, (1, dt.datetime(2024, 1, 9)): 30,
                   (2, dt.datetime(2024, 1, 4)): 100, (3, dt.datetime(2024, 1, 4)): 100}


def alerts(spark):
    rows = [("a", "LOW_STOCK", "WARNING", 1, "SKU-1", "t", "m", T0),
            ("b", "LOW_STOCK", "CRITICAL", 2, "SKU-2", "t", "m", T0 + dt.timedelta(hours=1)),
            ("c", "DEMAND_SURGE", "CRITICAL", 1, "SKU-1", "t", "m", T0 + dt.timedelta(hours=2)),
            ("d", "LOW_DEMAND_FORECAST", "INFO", 3, "SKU-3", "t", "m", T0 + dt.timedelta(hours=3))]
    return spark.createDataFrame(rows, "id string, type string, severity string, product_id long, sku string, "
                                       "title string, message string, occurred_at timestamp")


def test_alert_query_precedence_and_order(spark):
    a = alerts(spark)
    assert [r.id for r in RD.alerts_query(a, sku="SKU-1").collect()] == ["c", "a"]
    assert [r.id for r in RD.alerts_query(a, type_="LOW_STOCK").collect()] == ["b", "a"]
    assert [r.id for r in RD.alerts_query(a, severity="CRITICAL").collect()] == ["c", "b"]
    # sku wins over type and severity
    assert [r.id for r in RD.alerts_query(a, sku="SKU-1", type_="LOW_STOCK", severity="INFO").collect()] == ["c", "a"]
    assert RD.alerts_query(a).count() == 4


def test_webhook_payload_and_log_lines(spark):
    a = alerts(spark)
    p = {r.id: json.loads(r.payload) for r in AL.webhook_payload(a).collect()}
    assert p["b"]["text"] == "*CRITICAL* — t\nm"
    att = p["b"]["attachments"][0]
    assert att["color"] == "#FF0000"
    assert [f["title"] for f in att["fields"]] == ["Type", "Severity", "SKU", "Time"]
    assert all(f["short"] is True for f in att["fields"])
    assert p["a"]["attachments"][0]["color"] == "#FFA500" and p["d"]["attachments"][0]["color"] == "#36A64F"
    lines = {r.id: (r.level, r.line) for r in AL.log_lines(a).collect()}
    assert lines["b"] == ("ERROR", "[ALERT] id=b type=LOW_STOCK severity=CRITICAL sku=SKU-2 | m")
    assert lines["a"][0] == "WARN" and lines["d"][0] == "INFO"


def test_order_total_and_reads(spark):
    items = spark.createDataFrame([(1, 10, "A", 2, Decimal("10.00")), (1, 11, "B", 3, Decimal("5.00"))],
                                  "order_id long, product_id long, sku string, quantity int, unit_price decimal(12,2)")
    (t,) = RD.order_totals(items).collect()
    assert t.total == Decimal("35.00")
    orders = spark.createDataFrame([(1, 5, "PENDING"), (2, 6, "CONFIRMED")], "id long, customer_id long, status string")
    v = {r.id: r for r in RD.order_view(orders, items).collect()}
    assert v[1].total == Decimal("35.00") and [i.subtotal for i in v[1]["items"]] == [Decimal("20.00"), Decimal("15.00")]
    assert v[2].items == [] and v[2].total == Decimal("0.00")
    products = spark.createDataFrame([(1, "Clothing", 5), (2, "Clothing", 2), (3, "Tools", 6)],
                                     "product_id long, category string, stock_quantity int")
    assert RD.products_by_category(products, "Clothing").count() == 2
    assert RD.products_by_category(products).count() == 3
    assert sorted(r.product_id for r in RD.low_stock_products(products, 5).collect()) == [1, 2]
    assert F is not None


@pytest.mark.parametrize("bucket", [("day",), ("hour",), ("hour", "day"), ("minute", "hour", "day")])
def test_stock_as_of_random_against_brute_force(spark, bucket):
    import numpy as np
    rng = np.random.default_rng(17)
    base = dt.datetime(2024, 1, 1)
    stock_rows, ev_rows = [], []
    for i in range(2000):
        p = 0 if rng.random() < 0.34 else int(rng.integers(1, 20))      # product 0 is hot
        stock_rows.append((p, base + dt.timedelta(minutes=int(rng.integers(0, 6 * 1440))), i,
                           int(rng.integers(0, 500))))
    for j in range(300):
        p = int(rng.integers(0, 22))                                      # 20, 21: no stock at all
        t = base + dt.timedelta(minutes=int(rng.integers(0, 7 * 1440)))
        if j % 10 == 0 and stock_rows:                                    # exact-instant ties
            t = stock_rows[j][1]
            p = stock_rows[j][0]
        ev_rows.append((p, t))
    ev_rows = list(set(ev_rows))
    stock = spark.createDataFrame(stock_rows, "product_id long, ts timestamp, event_id long, balance long")
    ev = spark.createDataFrame(ev_rows, "product_id long, occurred_at timestamp")
    got = {(r.product_id, r.occurred_at): r.current_stock
           for r in AL.stock_as_of(ev, stock, buckets=bucket).collect()}
    for p, t in ev_rows:
        cands = [(ts, i, b) for q, ts, i, b in stock_rows if q == p and ts <= t]
        want = max(cands)[2] if cands else 100
        assert got[(p, t)] == want, (p, t)
