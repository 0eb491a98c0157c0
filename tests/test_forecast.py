"""Forecast operators: numeric goldens, validation rules and a brute-force
numpy evaluation of the same formulas on the test tables."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quayside.operators import forecast as FC

START = dt.date(2024, 1, 1)


def hist(spark, series: dict[str, list[float]]):
    rows = [(k, START + dt.timedelta(days=i), float(v)) for k, ys in series.items() for i, v in enumerate(ys)]
    return spark.createDataFrame(rows, "product_id string, ds date, y double")


def run(spark, series, horizon):
    h = hist(spark, series)
    model = FC.fit(h, ["product_id"])
    pts = FC.points(model, ["product_id"], horizon).toPandas().sort_values(["product_id", "date"])
    return model.toPandas().set_index("product_id"), pts


def ramp(n):
    return [10 + 0.5 * i for i in range(n)]


def test_ramp_30_days_horizon_14(spark):
    model, pts = run(spark, {"p": ramp(30)}, 14)
    assert model.loc["p", "mae"] == 0.0
    first, last = pts.iloc[0], pts.iloc[-1]
    assert first["date"] == dt.date(2024, 1, 31)
    assert (first["predicted_quantity"], first["lower_bound"], first["upper_bound"]) == (25.79, 18.21, 33.37)
    assert last["date"] == dt.date(2024, 2, 13)
    assert (last["predicted_quantity"], last["lower_bound"], last["upper_bound"]) == (31.5, 22.24, 40.76)
    assert round(pts["predicted_quantity"].sum(), 2) == 395.51
    assert len(pts) == 14
    assert (pts["lower_bound"] <= pts["predicted_quantity"]).all()
    assert (pts["predicted_quantity"] <= pts["upper_bound"]).all()


def test_ramp_14_days_horizon_7(spark):
    model, pts = run(spark, {"p": ramp(14)}, 7)
    first, last = pts.iloc[0], pts.iloc[-1]
    assert first["date"] == dt.date(2024, 1, 15)
    assert (first["predicted_quantity"], first["lower_bound"], first["upper_bound"]) == (15.98, 11.28, 20.68)
    assert last["date"] == dt.date(2024, 1, 21)
    assert (last["predicted_quantity"], last["lower_bound"], last["upper_bound"]) == (20.8, 14.68, 26.92)


@pytest.mark.parametrize("series,first,total", [
    ([7.0] * 30, (7.0, 4.94, 9.06), 210.0),
    ([6.0] * 30, (6.0, 4.24, 7.76), 180.0),
    ([0.0] * 30, (0.0, 0.0, 0.98), None),
    ([max(0, 30 - 2 * i) for i in range(30)], (0.0, 0.0, 0.98), None),
])
def test_flat_and_falling_series(spark, series, first, total):
    horizon = 30 if total is not None else 3
    model, pts = run(spark, {"p": series}, horizon)
    p0 = pts.iloc[0]
    assert (p0["predicted_quantity"], p0["lower_bound"], p0["upper_bound"]) == first
    assert model.loc["p", "mae"] == 0.0
    if total is not None:
        assert round(pts["predicted_quantity"].sum(), 2) == total


def test_ramp_60_gives_horizon_points(spark):
    _, pts = run(spark, {"a": ramp(60), "b": ramp(14)}, 30)
    assert pts.groupby("product_id").size().to_dict() == {"a": 30, "b": 30}
    assert (pts["lower_bound"] >= 0).all()


def test_history_rules(spark):
    h = hist(spark, {"short": ramp(13), "ok": ramp(14), "neg": [1.0] * 13 + [-1.0], "arima": ramp(20),
                     "far": ramp(20)})
    req = spark.createDataFrame(
        [("short", "S", 30, "prophet"), ("ok", "O", 30, "prophet"), ("neg", "N", 30, "prophet"),
         ("arima", "A", 30, "arima"), ("far", "F", 366, "prophet"), ("none", "X", 30, None)],
        "product_id string, sku string, horizon_days int, model string")
    out = {r.product_id: r.failure_reason for r in FC.history_checks(h, req, ["product_id"]).collect()}
    assert out["ok"] is None
    assert out["short"] == "history needs at least 14 points, got 13"
    assert out["neg"] == "quantity must be greater than or equal to 0"
    assert out["arima"] == "Unsupported model: arima"
    assert out["far"] == "horizonDays must be between 1 and 365"
    assert out["none"] == "history needs at least 14 points, got 0"


def test_jobs_keep_failed_series(spark):
    h = hist(spark, {"short": ramp(13), "ok": ramp(30)})
    req = spark.createDataFrame([("short", "S", 14, "prophet"), ("ok", "O", 14, "prophet")],
                                "product_id string, sku string, horizon_days int, model string")
    jobs, pts = FC.run_jobs(req, h, ["product_id"])
    j = {r.product_id: r for r in jobs.collect()}
    assert j["short"].status == "FAILED" and j["short"].model_used is None
    assert j["ok"].status == "COMPLETED" and j["ok"].model_used == "linear-trend"
    assert float(j["ok"].total_predicted_demand) == 395.51
    assert pts.count() == 14


def test_two_requests_of_one_series_and_a_null_horizon(spark):
    h = hist(spark, {"a": ramp(30)})
    req = spark.createDataFrame([("a", 1, 7, "prophet"), ("a", 2, None, None), ("a", 3, 14, "prophet"), ("a", 4, 3, "flat"),
                                 ("a", 5, 3, "arima")], "product_id string, no int, horizon_days int, model string")

    def flat(pdf, horizon):
        days = pd.date_range(pdf["ds"].iloc[-1], periods=horizon + 1)[1:].date
        return pd.DataFrame({"date": days, "predicted_quantity": 2.0, "lower_bound": 1.0, "upper_bound": 3.0})

    jobs, pts = FC.run_jobs(req, h, ["product_id"], request=["product_id", "no"], registry={"flat": flat})
    j = {r.no: r for r in jobs.collect()}
    n = {r.no: r["count"] for r in pts.groupBy("no").count().collect()}
    assert len({r.id for r in j.values()}) == 5 and n == {1: 7, 2: 30, 3: 14, 4: 3}
    assert float(j[3].total_predicted_demand) == 395.51 and j[2].horizon_days == 30
    one = {r.no: r.t for r in pts.groupBy("no").agg({"predicted_quantity": "sum"}).toDF("no", "t").collect()}
    assert all(abs(one[k] - float(j[k].total_predicted_demand)) < 0.006 for k in n)
    assert j[1].mae == j[2].mae is not None and j[4].mae is None and j[4].model_used == "flat"
    assert j[5].status == "FAILED" and j[5].error_message == "Unsupported model: arima"


def _numpy_forecast(ys, horizon, days):
    """Brute force: least squares by numpy, per-weekday means, same rounding."""
    n = len(ys)
    last = days[-1]
    k = max(1, int(n * 0.8))
    x = np.arange(k)
    a, c = np.polyfit(x, ys[:k], 1)
    dows = pd.Series(ys[:k]).groupby([d.weekday() for d in days[:k]]).mean()
    g = ys[:k].mean() if ys[:k].mean() > 0 else 1.0
    out = []
    for i in range(horizon):
        d = last + dt.timedelta(days=i + 1)
        t = a * (n + i) + c
        f = dows.get(d.weekday(), g) / g
        out.append(max(0.0, np.rint(t * f * 100) / 100))
    return out


def test_against_numpy_on_test_tables(spark):
    """Daily demand of the sf0.001 tables; numpy's polyfit may differ by one
    cent on rounding ties, so 0.01 tolerance."""
    from quayside.plans import catalog

    base = "/root/testdata/sf0.001"
    h = catalog.history(spark, base).toPandas()
    good = h.groupby("product_id").filter(lambda g: len(g) >= 14)
    if good.empty:
        pytest.skip("no series long enough at this scale")
    pts = FC.points(FC.fit(spark.createDataFrame(good), ["product_id"]), ["product_id"], 10).toPandas()
    for pid, g in good.groupby("product_id"):
        g = g.sort_values("ds")
        want = _numpy_forecast(g["y"].to_numpy(float), 10, list(g["ds"]))
        got = pts[pts.product_id == pid].sort_values("date")["predicted_quantity"].to_list()
        assert np.allclose(got, want, atol=0.0101), pid


def test_seed_history_and_per_item_jobs(spark):
    items = spark.createDataFrame([(1, 0, dt.datetime(2024, 2, 1, 10), 7), (1, 1, dt.datetime(2024, 2, 1, 10), 6)],
                                  "order_id long, item_pos int, occurred_at timestamp, quantity int")
    seeds = FC.seed_history(items, ["order_id", "item_pos"])
    s = seeds.where("item_pos = 0").orderBy("ds").toPandas()
    assert len(s) == 30 and s["ds"].iloc[0] == dt.date(2024, 1, 2) and s["ds"].iloc[-1] == dt.date(2024, 1, 31)
    pts = FC.points(FC.fit(seeds, ["order_id", "item_pos"]), ["order_id", "item_pos"], 30)
    tot = {r.item_pos: float(r.total_predicted_demand) for r in FC.total_demand(pts, ["item_pos"]).collect()}
    assert tot == {0: 210.0, 1: 180.0}


def test_custom_model_hook(spark):
    h = hist(spark, {"p": ramp(20)})

    def naive(pdf, horizon):
        last = pdf["ds"].iloc[-1]
        return pd.DataFrame({"product_id": pdf["product_id"].iloc[0],
                             "date": [last + dt.timedelta(days=i) for i in range(1, horizon + 1)],
                             "predicted_quantity": float(pdf["y"].iloc[-1]), "lower_bound": 0.0,
                             "upper_bound": 99.0})

    out = FC.forecast_with("naive", h, ["product_id"], 5, registry={"naive": naive}).toPandas()
    assert len(out) == 5 and (out["predicted_quantity"] == 19.5).all()
    with pytest.raises(ValueError, match="Unsupported model: arima"):
        FC.forecast_with("arima", h, ["product_id"], 5)


def test_daily_demand_sums_per_day(spark):
    items = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1, 9), 2), (1, dt.datetime(2024, 1, 1, 18), 3), (1, dt.datetime(2024, 1, 2, 1), 4)],
        "product_id long, occurred_at timestamp, quantity int")
    got = {(r.ds, r.y) for r in FC.daily_demand(items).collect()}
    assert got == {(dt.date(2024, 1, 1), 5.0), (dt.date(2024, 1, 2), 4.0)}
    assert F is not None


def test_daily_demand_recent_window(spark):
    items = spark.createDataFrame(
        [(1, dt.datetime(2024, 3, d, 12), 1) for d in range(1, 11)],
        "product_id long, occurred_at timestamp, quantity int")
    got = FC.daily_demand(items, since_days=3, as_of=F.lit(dt.date(2024, 3, 10))).collect()
    assert sorted(r.ds.day for r in got) == [8, 9, 10]


def test_models_of_pairs_equal_models_of_items(spark):
    """Fitting distinct (quantity, day) pairs gives every item the model of its own
    history, items with nulls and repeated rows included."""
    import datetime as dt
    t0 = dt.datetime(2024, 3, 1, 15)
    rows = [(k, k % 4, t0 + dt.timedelta(days=k % 3, hours=k % 5)) for k in range(60)]
    rows += [(100, None, t0), (101, 2, None), (102, None, t0 + dt.timedelta(days=1))]
    items = spark.createDataFrame(rows, "item long, quantity int, occurred_at timestamp")
    got = FC.seed_models(items, ["item"], carry=["quantity"])
    own = FC.fit(FC.seed_history(items, ["item"]), ["item"])
    own = own.withColumn("total_predicted_demand", FC.horizon_total(F.lit(30))).join(items.select("item", "quantity"), "item")
    assert sorted(map(tuple, got.select(own.columns).collect()), key=str) == sorted(map(tuple, own.collect()), key=str)
    assert got.count() == 62


def test_user_model_on_many_series_at_once(spark):
    """A model marked with takes_many gets whole series in day order, whatever batch
    they end in, and answers as one that is called per series."""
    rng = np.random.default_rng(5)
    rows = [(s, dt.date(2024, 1, 1) + dt.timedelta(days=int(d)), float(rng.integers(0, 50)), 2 + s % 3)
            for s in range(40) for d in rng.permutation(1 + s % 13)]
    h = spark.createDataFrame(rows, "sid int, ds date, y double, days int").repartition(3)

    def plain(pdf, horizon):
        return pd.DataFrame({"sid": pdf["sid"].iloc[0], "step": range(horizon), "total": pdf["y"].sum(), "last": pdf["y"].iloc[-1]})

    @FC.takes_many
    def many(history, series, horizon):
        n = len(series) - 1
        y = history["y"].to_numpy()
        return pd.DataFrame({"step": np.tile(np.arange(horizon), n), "total": np.repeat(np.add.reduceat(y, series[:-1]), horizon),
                             "last": np.repeat(y[series[1:] - 1], horizon)})

    schema = "sid int, step int, total double, last double"
    for horizon in (3, "days"):
        want = sorted(map(tuple, FC._per_series(h, ["sid"], plain, schema, horizon).collect()))
        for size in (1, 10, 1000):
            assert sorted(map(tuple, FC._per_series(h, ["sid"], many, schema, horizon, size).collect())) == want
    assert not FC._per_series(h.limit(0), ["sid"], many, schema, 3).collect()


def test_a_day_that_is_null_comes_last_for_marked_models_too(spark):
    h = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1.0), (1, None, 3.0), (2, dt.date(2024, 1, 1), 2.0)], "product_id long, ds date, y double")
    from quayside.plans.catalog import _mean_model
    got = FC.forecast_with("mean", h, ["product_id"], 1, registry={"mean": _mean_model}).collect()
    assert sorted((r.product_id, r.date, r.predicted_quantity) for r in got) == [(1, None, 2.0), (2, dt.date(2024, 1, 2), 2.0)]
