"""What rows say to the constraint audit."""

import datetime as dt

from quayside.operators import forecast as FC
from quayside.operators import validate as VD
from pyspark.sql import functions as F


def test_points_are_tagged_by_compiled_cases(spark):
    kind = "job_id string, forecast_date date, predicted_quantity decimal(12,4), lower_bound decimal(12,4), upper_bound decimal(12,4)"
    day = dt.date(2024, 1, 1)
    rows = [("a", day, 1, 1, 1), ("a", None, 1, 1, 1), (None, day, 1, 1, 1), (None, None, None, 1, 1), ("b", day, -1, None, 1)]
    from decimal import Decimal
    points = spark.createDataFrame([(a, b, *(v if v is None else Decimal(v) for v in c)) for a, b, *c in rows], kind)
    tags = VD._tagged("forecast_points", points)
    plan = tags._jdf.queryExecution().executedPlan().toString()
    # no filter of an array, which is interpreted row by row
    assert "lambdafunction" not in plan and "filter(" not in plan.lower().replace("filter (", "")
    at = {k: name for k, name in enumerate(VD._spaces())}
    got = sorted((at[r.space], r.key, r.role) for r in tags.collect())
    names = list(VD.column_rules("forecast_points"))
    bits = lambda *rules: str(sum(1 << names.index(r) for r in rules))
    job = "forecast_jobs.id"
    want = [(job, "a", VD.CHILD), (job, "a", VD.CHILD), (job, "b", VD.CHILD)]
    want += [("forecast_points", bits(*r), VD.RULES) for r in (
        ["forecast_date_not_null"], ["job_id_not_null"], ["job_id_not_null", "forecast_date_not_null", "predicted_quantity_not_null"],
        ["lower_bound_not_null", "predicted_non_negative"])]
    assert got == sorted(want)


def test_a_row_with_two_unique_keys_names_both(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (None, "y")], "product_id long, sku string")
    for c, (kind, v) in {"name": ("string", "n"), "category": ("string", "c"), "price": ("decimal(12,2)", 1), "stock_quantity": ("int", 1),
                         "created_at": ("timestamp", "2024-01-01"), "updated_at": ("timestamp", "2024-01-01"), "version": ("bigint", 0)}.items():
        df = df.withColumn(c, F.lit(v).cast(kind))
    at = {k: name for k, name in enumerate(VD._spaces())}
    got = {(at[r.space], r.key) for r in VD._tagged("products", df).collect() if r.role == VD.OWNER}
    assert got == {("products.product_id", "1"), ("products.product_id", "2"), ("products.sku", "x"), ("products.sku", "y")}


def test_point_arrays_are_the_points(spark):
    d = dt.date(2024, 5, 6)
    rows = [(k, 30 + k, 0.3 * k - 1, 2.0 - k, d + dt.timedelta(days=k), *(1.0 + 0.1 * ((k + i) % 5) for i in range(7))) for k in range(20)]
    cols = "s int, n long, slope double, intercept double, last_ds date, " + ", ".join(f"f{i} double" for i in range(7))
    model = spark.createDataFrame(rows, cols)
    arrays = model.select("s", F.inline(FC.point_array(F.lit(9))))
    assert sorted(map(tuple, arrays.collect())) == sorted(map(tuple, FC.points(model, ["s"], 9).collect()))
