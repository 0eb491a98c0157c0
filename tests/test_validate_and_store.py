"""Request rules, joins for admission/deletion, and upserts."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from quayside.operators import reads as RD
from quayside.operators import validate as VD
from quayside.sources import store as ST

T0 = dt.datetime(2024, 1, 1)


def test_product_rules(spark):
    rows = [("Widget", "SKU-001", "Electronics", Decimal("9.99"), 50),
            ("Widget", "SKU-002", "Electronics", Decimal("9.99"), -1),
            ("Widget", "SKU-003", "Electronics", None, 1),
            ("Widget", "SKU-004", "Electronics", Decimal("-0.01"), 1),
            ("", "bad sku", " ", Decimal("0.00"), 1)]
    df = spark.createDataFrame(rows, "name string, sku string, category string, price decimal(12,2), initial_stock int")
    got = [(r.accepted, r.errors) for r in VD.validate_products(df).collect()]
    assert got[0] == (True, "")
    assert got[1] == (False, "initialStock: initialStock cannot be negative")
    assert got[2] == (False, "price: price is required")
    assert got[3] == (False, "price: price must be positive")
    assert got[4] == (False, "name: name is required, sku: SKU must be 3-20 uppercase alphanumeric characters, "
                             "category: category is required, price: price must be positive")


def test_delta_and_request_rules(spark):
    d = spark.createDataFrame([(1, -5), (2, None)], "id long, delta int")
    assert [r.errors for r in VD.validate_stock_deltas(d).orderBy("id").collect()] == ["", "delta: delta is required"]
    req = spark.createDataFrame([(1, "S", h) for h in (0, -1, 366, 1000, 1, 30, 365)],
                                "product_id long, sku string, horizon_days int")
    hist = spark.createDataFrame([(1, T0.date(), 1.0)], "product_id long, ds date, y double")
    ok = [r.accepted for r in VD.validate_forecast_requests(req, hist).collect()]
    assert ok == [False, False, False, False, True, True, True]


def test_order_rules(spark):
    orders = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "id long, customer_id long")
    items = spark.createDataFrame([(1, 10, "A", 1, Decimal("0.01")), (3, 11, "B", 0, Decimal("1.00"))],
                                  "order_id long, product_id long, sku string, quantity int, unit_price decimal(12,2)")
    got = {r.id: (r.accepted, r.errors) for r in VD.validate_orders(orders, items).collect()}
    assert got[1] == (True, "")
    assert got[2] == (False, "customerId: must not be null, items: Order must have at least one item")
    assert got[3] == (False, "items.quantity: must be greater than or equal to 1 (1)")
    items = spark.createDataFrame([(1, None, " ", 0, None), (1, 10, "A", 1, Decimal("0.00")), (1, 10, "A", 1, Decimal("1.00"))],
                                  "order_id long, product_id long, sku string, quantity int, unit_price decimal(12,2)")
    (r,) = VD.validate_orders(orders.where("id = 1"), items).collect()
    assert (r.n_items, r.n_bad_items, r.accepted) == (3, 2, False)
    assert r.errors == ("items.productId: must not be null (1), items.sku: must not be blank (1), items.quantity: must be greater than or equal to 1 (1), "
                        "items.unitPrice: must not be null (1), items.unitPrice: must be greater than or equal to 0.01 (1)")


def test_admission_and_orphans(spark):
    stored = spark.createDataFrame([(1, "SKU-001")], "product_id long, sku string")
    incoming = spark.createDataFrame([(5, "SKU-001", T0), (6, "SKU-009", T0 + dt.timedelta(1)),
                                      (7, "SKU-009", T0)], "product_id long, sku string, created_at timestamp")
    ok, bad = RD.admit_new_products(incoming, stored)
    assert [r.product_id for r in ok.collect()] == [7]
    assert sorted((r.product_id, r.reason) for r in bad.collect()) == [
        (5, "SKU already exists: SKU-001"), (6, "SKU already exists: SKU-009")]
    assert [r.product_id for r in RD.existing_skus(incoming, stored).collect()] == [5]
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    kids = spark.createDataFrame([(1, "a"), (3, "b")], "order_id long, x string")
    assert [r.x for r in RD.orphan_children(kids, parents, "order_id").collect()] == ["b"]
    ids = spark.createDataFrame([(1,), (9,)], "requested_id long")
    kp, kc, unk = RD.delete_cascade(parents, kids, ids, "order_id")
    assert [r.id for r in kp.collect()] == [2] and [r.x for r in kc.collect()] == ["b"]
    assert [r.requested_id for r in unk.collect()] == [9]


def test_upsert_products(spark):
    cols = ("product_id long, name string, sku string, category string, price decimal(12,2), stock_quantity int, "
            "created_at timestamp, updated_at timestamp")
    stored = spark.createDataFrame([(1, "A", "S1", "C", Decimal("1.00"), 5, T0, T0, 0),
                                    (2, "B", "S2", "C", Decimal("2.00"), 6, T0, T0, 3)], cols + ", version long")
    t1 = T0 + dt.timedelta(days=1)
    incoming = spark.createDataFrame([(2, "B2", "S2", "C", Decimal("2.50"), 70, t1, t1),
                                      (3, "N", "S3", "C", Decimal("3.00"), 1, t1, t1)], cols)
    got = {r.product_id: r for r in ST.upsert_products(stored, incoming).collect()}
    assert (got[1].name, got[1].version) == ("A", 0)
    assert (got[2].name, got[2].price, got[2].stock_quantity, got[2].created_at, got[2].version) == \
        ("B2", Decimal("2.50"), 70, T0, 4)
    assert (got[3].version, got[3].created_at) == (0, t1)


JOB_COLS = ("id string, product_id long, sku string, horizon_days int, status string, model_used string, "
            "mae decimal(10,4), error_message string, created_at timestamp, updated_at timestamp")


def test_upsert_jobs_keeps_result_and_creation_time(spark):
    t1, t2, t3 = (T0 + dt.timedelta(hours=h) for h in (1, 2, 3))
    stored = spark.createDataFrame([("j", 1, "S", 30, "COMPLETED", "linear-trend", Decimal("1.5"), None, T0, T0, 0)],
                                   JOB_COLS + ", version long")
    incoming = spark.createDataFrame(
        [("j", 1, "S", 30, "RUNNING", None, None, None, t1, t1), ("j", 1, "S", 30, "FAILED", None, None, "boom", t2, t2),
         ("n", 2, "N", 7, "RUNNING", None, None, None, t1, t1),
         ("n", 2, "N", 7, "COMPLETED", "linear-trend", Decimal("2.5"), None, t2, t2),
         ("n", 2, "N", 7, "COMPLETED", None, None, None, t3, t3)], JOB_COLS)
    got = {r.id: r for r in ST.upsert_forecast_jobs(stored, incoming).collect()}
    assert tuple(got["j"][c] for c in ("status", "model_used", "mae", "error_message", "created_at", "updated_at", "version")) == \
        ("FAILED", "linear-trend", Decimal("1.5000"), "boom", T0, t2, 2)
    assert tuple(got["n"][c] for c in ("status", "model_used", "mae", "created_at", "updated_at", "version")) == \
        ("COMPLETED", "linear-trend", Decimal("2.5000"), t3, t3, 2)


def test_points_are_replaced_only_by_a_result(spark):
    jobs = spark.createDataFrame([("a", "linear-trend"), ("b", None)], "id string, model_used string")
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "job_id string, p int")
    new = spark.createDataFrame([("a", 9), ("b", 9)], "job_id string, p int")
    assert sorted(map(tuple, ST.replace_points(old, jobs, new).collect())) == [("a", 9), ("b", 1), ("c", 1)]


def test_upsert_orders_last_write_wins(spark):
    t1, t2 = T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2)
    cols = "id long, customer_id long, status string, created_at timestamp, updated_at timestamp"
    items = "order_id long, product_id long, quantity int"
    stored = spark.createDataFrame([(1, 5, "PENDING", T0, T0, 3), (2, 5, "PENDING", T0, T0, 0)], cols + ", version long")
    stored_items = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], items)
    incoming = spark.createDataFrame([(1, 5, "CONFIRMED", T0, t1), (1, 5, "CANCELLED", T0, t2), (3, 6, "PENDING", t1, t1)], cols)
    new_items = spark.createDataFrame([(1, 11, 1, t1), (1, 12, 2, t2), (3, 30, 1, t1)], items + ", updated_at timestamp")
    o, i = ST.upsert_orders(stored, stored_items, incoming, new_items)
    assert sorted((r.id, r.status, r.version) for r in o.collect()) == [(1, "CANCELLED", 5), (2, "PENDING", 0), (3, "PENDING", 0)]
    assert sorted(map(tuple, i.collect())) == [(1, 12, 2), (2, 20, 1), (3, 30, 1)]


def test_append_alerts_skips_known_ids(spark, tmp_path):
    cols = "id string, type string, severity string, product_id long, sku string, title string, message string, " \
           "occurred_at timestamp"
    path = str(tmp_path / "alerts")
    a = spark.createDataFrame([("x", "LOW_STOCK", "WARNING", 1, "S", "t", "m", T0)], cols)
    ST.append_alerts(a, path)
    b = spark.createDataFrame([("x", "LOW_STOCK", "WARNING", 1, "S", "t", "m", T0),
                               ("y", "LOW_STOCK", "WARNING", 1, "S", "t", "m", T0)], cols)
    ST.append_alerts(b, path, existing=spark.read.parquet(path))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["x", "y"]


def test_upsert_products_several_writes_last_wins(spark):
    cols = ("product_id long, name string, sku string, category string, price decimal(12,2), stock_quantity int, "
            "created_at timestamp, updated_at timestamp")
    stored = spark.createDataFrame([(1, "A", "S1", "C", Decimal("1.00"), 5, T0, T0, 2)], cols + ", version long")
    t1, t2 = T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=2)
    incoming = spark.createDataFrame([(1, "A2", "S1", "C", Decimal("1.50"), 7, t1, t2),
                                      (1, "A1", "S1", "C", Decimal("1.20"), 6, t1, t1),
                                      (5, "N1", "S5", "C", Decimal("3.00"), 1, t1, t1),
                                      (5, "N2", "S5", "C", Decimal("3.10"), 2, t1, t2)], cols)
    got = {r.product_id: r for r in ST.upsert_products(stored, incoming).collect()}
    assert (got[1].name, got[1].stock_quantity, got[1].version, got[1].created_at) == ("A2", 7, 4, T0)
    assert (got[5].name, got[5].version, got[5].created_at) == ("N2", 1, t1)


def test_order_item_rules(spark):
    items = spark.createDataFrame(
        [(1, 10, "A", 1, Decimal("0.01")), (1, None, " ", 0, None), (2, 11, "B", 2, Decimal("0.00"))],
        "order_id long, product_id long, sku string, quantity int, unit_price decimal(12,2)")
    got = sorted((r.order_id, r.accepted, r.errors) for r in VD.validate_order_items(items).collect())
    assert got == [
        (1, False, "productId: must not be null, sku: must not be blank, "
                   "quantity: must be greater than or equal to 1, unitPrice: must not be null"),
        (1, True, ""),
        (2, False, "unitPrice: must be greater than or equal to 0.01")]


def test_write_version_and_keyed_topic(spark, tmp_path):
    import json
    import os
    from quayside.sources import events as EV
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    p1 = ST.write_version(df, str(tmp_path / "t"), 1)
    p2 = ST.write_version(df.where("id = 1"), str(tmp_path / "t"), 2)
    assert spark.read.parquet(p1).count() == 2 and spark.read.parquet(p2).count() == 1
    rec = spark.createDataFrame([("k1", '{"x":2}', 2), ("k1", '{"x":1}', 1), ("k2", '{"x":3}', 3)],
                                "key string, value string, seq long")
    EV.write_topic(rec, str(tmp_path / "topic"), ("seq",), partitions=2)
    by_file = {}
    for f in os.listdir(tmp_path / "topic"):
        if f.endswith(".json"):
            lines = [json.loads(x) for x in open(tmp_path / "topic" / f)]
            for r in lines:
                by_file.setdefault(r["key"], []).append((f, r["value"]))
    # one key's records sit in one file, in order
    assert len({f for f, _ in by_file["k1"]}) == 1
    assert [v for _, v in by_file["k1"]] == ['{"x":1}', '{"x":2}']


def test_every_table_rule_counts_its_violation(spark):
    """All 70 rules of the reference's DDL: a clean table breaks none, and for
    each rule one broken row (two for a repeated key) is counted."""
    from quayside import schemas as S
    schemas = {"products": S.PRODUCTS, "orders": S.ORDERS, "order_items": S.ORDER_ITEMS, "forecast_jobs": S.FORECAST_JOBS,
               "forecast_points": S.FORECAST_POINTS, "alerts": S.ALERTS}
    good = {"products": ("1", "n", "S", "c", Decimal("0.00"), 0, T0, T0, 0), "orders": ("1", "7", "PENDING", T0, T0, 0),
            "order_items": ("1", "1", "S", 1, Decimal("0.00")),
            "forecast_jobs": ("1", "1", "S", 365, "FAILED", None, None, None, T0, T0, 0),
            "forecast_points": ("1", T0.date(), Decimal("0"), Decimal("0"), Decimal("0")),
            "alerts": ("1", "t", "s", "1", "S", "t", "m", T0)}
    bad = {"price_non_negative": ("price", Decimal("-1")), "stock_non_negative": ("stock_quantity", -1), "status_allowed": ("status", "X"),
           "quantity_positive": ("quantity", 0), "unit_price_non_negative": ("unit_price", Decimal("-1")), "horizon_range": ("horizon_days", 366),
           "predicted_non_negative": ("predicted_quantity", Decimal("-1")), "order_fk": ("order_id", "9"), "job_fk": ("job_id", "9")}
    rows, want = {t: [r] for t, r in good.items()}, {}
    for t, ddl in VD.DDL.items():
        names = schemas[t].names
        rules = [(f"{c}_not_null", c, None) for c in ddl["not_null"]]
        rules += [(f"{c}_length_{n}", c, "é" * (n + 1)) for c, n in ddl.get("lengths", {}).items()]
        rules += [(name, *bad[name]) for name in [*ddl.get("checks", ()), *[p[0] for p in [ddl.get("parent")] if p]]]
        for k, (rule, column, value) in enumerate(rules):
            row = dict(zip(names, good[t])) | {u: f"{u[0]}{k}" for u in ddl.get("unique", ())} | {column: value}
            rows[t].append(tuple(row[n] for n in names))
            want[t, rule] = 1
        for u in ddl.get("unique", ()):
            rows[t].append(tuple((dict(zip(names, good[t])) | {v: f"u{u}" for v in ddl["unique"] if v != u})[n] for n in names))
            want[t, f"{u}_unique"] = 2
    for t in ("orders", "forecast_jobs"):  # a status that is too long is also not allowed
        want[t, "status_allowed"] += 1
    assert len(want) == 70
    frames = {t: spark.createDataFrame(r, schemas[t]) for t, r in rows.items()}
    got = VD.audit_constraints(frames).collect()
    assert {(r.table_name, r.rule): r.violations for r in got} == want and len(got) == 70
    clean = VD.audit_constraints({t: spark.createDataFrame([r], schemas[t]) for t, r in good.items()})
    assert not any(r.violations for r in clean.collect())


def test_registered_audit_has_a_violation_of_every_rule(spark):
    from quayside.plans import catalog as CA
    rows = CA.q_audit_constraints(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 70 and all(r.violations > 0 for r in rows)


def test_audit_has_two_exchanges(spark):
    from quayside import schemas as S
    tables = {"products": S.PRODUCTS, "orders": S.ORDERS, "order_items": S.ORDER_ITEMS, "forecast_jobs": S.FORECAST_JOBS,
              "forecast_points": S.FORECAST_POINTS, "alerts": S.ALERTS}
    df = VD.audit_constraints({t: spark.createDataFrame([], s) for t, s in tables.items()})
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert p.count("Exchange ") == 2 and "Join" not in p and "partial_count_if" not in p.split("Exchange ")[0]


def test_audit_of_a_hot_parent_and_of_orphans(spark):
    """Children of one order are added up before the shuffle; children without a
    parent count one by one; null keys break no key rule."""
    from quayside import schemas as S
    empty = {t: spark.createDataFrame([], s) for t, s in (("products", S.PRODUCTS), ("forecast_jobs", S.FORECAST_JOBS),
                                                         ("forecast_points", S.FORECAST_POINTS), ("alerts", S.ALERTS))}
    orders = spark.createDataFrame([("1", "7", "PENDING", T0, T0, 0), (None, "7", "PENDING", T0, T0, 0), (None, "7", "PENDING", T0, T0, 0)], S.ORDERS)
    items = spark.createDataFrame([("1", "1", "S", 1, Decimal("0.00"))] * 50 + [("2", "1", "S", 1, Decimal("0.00"))] * 3
                                  + [(None, "1", "S", 1, Decimal("0.00"))], S.ORDER_ITEMS)
    got = {(r.table_name, r.rule): r.violations for r in VD.audit_constraints({**empty, "orders": orders, "order_items": items}).collect()}
    assert {k: v for k, v in got.items() if v} == {("orders", "id_not_null"): 2, ("order_items", "order_id_not_null"): 1, ("order_items", "order_fk"): 3}
    assert len(got) == 70


def test_write_numbers_decide_between_equal_instants(spark):
    """Two writes of one batch to one row at one instant: the one with the larger
    number wins, whatever its content sorts like; its items and points stay alone."""
    jobs = spark.createDataFrame([("a", 1, "S", 30, "RUNNING", None, None, None, T0, T0, 0)],
                                 "id string, product_id long, sku string, horizon_days int, status string, model_used string, "
                                 "mae decimal(10,4), error_message string, created_at timestamp, updated_at timestamp, version long")
    w = jobs.drop("version").withColumns({"write_no": F.lit(1), "status": F.lit("RUNNING")})
    x = w.withColumns({"write_no": F.lit(2), "status": F.lit("COMPLETED"), "model_used": F.lit("a-model")})
    y = w.withColumns({"write_no": F.lit(3), "status": F.lit("COMPLETED"), "model_used": F.lit("A-model")})
    got = ST.upsert_forecast_jobs(jobs, w.unionByName(x).unionByName(y)).collect()
    assert [(r.status, r.model_used, r.version) for r in got] == [("COMPLETED", "A-model", 3)]
    points = spark.createDataFrame([("a", T0.date(), 1), ("b", T0.date(), 1)], "job_id string, forecast_date date, q int")
    incoming = spark.createDataFrame([("a", T0.date(), 20, 2), ("a", T0.date(), 30, 3)], "job_id string, forecast_date date, q int, write_no int")
    kept = ST.replace_points(points, w.unionByName(x).unionByName(y), incoming)
    assert sorted((r.job_id, r.q) for r in kept.collect()) == [("a", 30), ("b", 1)]

    orders = spark.createDataFrame([(1, 7, "PENDING", T0, T0, 0)], "id long, customer_id long, status string, created_at timestamp, updated_at timestamp, version long")
    items = spark.createDataFrame([(1, 10, 1)], "order_id long, product_id long, quantity int")
    a = orders.drop("version").withColumns({"write_no": F.lit(1), "status": F.lit("SHIPPED")})
    b = orders.drop("version").withColumns({"write_no": F.lit(2), "status": F.lit("CONFIRMED")})
    new = spark.createDataFrame([(1, 10, 2, 1), (1, 11, 3, 2)], "order_id long, product_id long, quantity int, write_no int")
    o, i = ST.upsert_orders(orders, items, a.unionByName(b), new)
    assert [r.status for r in o.collect()] == ["CONFIRMED"] and [tuple(r) for r in i.collect()] == [(1, 11, 3)]
