"""Jobs and their points: made per pair, moved and grouped per job."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from quayside.operators import forecast as FC
from quayside.operators import reads as RD
from quayside.plans import catalog as CA

BASE = "/root/testdata/sf0.001"


def plan(spark, df) -> str:
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def same_rows(a, b) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and not a.isEmpty()


def test_points_may_come_as_arrays(spark):
    """Arrays of points in several rows of a job, and points a row each, give the same."""
    jobs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "id string, product_id int")
    kind = "forecast_date date, predicted_quantity decimal(12,4), lower_bound decimal(12,4), upper_bound decimal(12,4)"
    day = lambda d, q: (dt.date(2024, 1, d), q, q, q)
    rows = [("a", [day(3, None), day(1, 2)]), ("a", [day(2, 5)]), (None, [day(4, 1)]), ("c", [day(5, 1)])]
    arrays = spark.createDataFrame([], f"x array<struct<{kind.replace(' d', ':d')}>>").schema["x"].dataType
    points = spark.createDataFrame(
        [(k, [(d, *(v if v is None else Decimal(v) for v in of)) for d, *of in ps]) for k, ps in rows],
        T.StructType([T.StructField("job_id", T.StringType()), T.StructField("points", arrays)]))
    got = RD.jobs_with_points(jobs, points)
    assert same_rows(got, RD.jobs_with_points(jobs, points.selectExpr("job_id", "inline(points)")))
    first = {r.product_id: [p.forecast_date.day for p in r.points or []] for r in got.collect()}
    assert first == {1: [1, 2, 3], 2: [1, 2, 3], 3: [], 4: []}


@pytest.mark.parametrize("query", [CA.q_jobs_with_points, CA.q_replace_forecast_points])
def test_items_are_moved_by_their_job_once_and_without_its_id(spark, query):
    p = plan(spark, lambda: query(spark, BASE))
    # no exchange by pair, and none whose rows hold an item's job id
    assert "hashpartitioning(_seed_day" not in p and not re.search(r"hashpartitioning\(id#", p)
    # the items' exchange is by the expression of the id, over what the id is made of
    moved = re.findall(r"(?<!Reused)Exchange hashpartitioning\(coalesce\(sha2[^\n]*REPARTITION_BY_NUM[^\n]*\n[^\n]*Generate explode\(sequence\(0", p)
    assert moved and "Generate explode(sequence(1, 30" not in p


def test_pairs_too_many_to_send_give_the_same_rows(spark, monkeypatch):
    few = [CA.q_jobs_with_points(spark, BASE), CA.q_replace_forecast_points(spark, BASE)]
    monkeypatch.setattr(FC, "SENT_PAIRS", 0)
    many = [CA.q_jobs_with_points(spark, BASE), CA.q_replace_forecast_points(spark, BASE)]
    for a, b in zip(few, many):
        assert same_rows(a, b)


def test_a_task_holds_a_bounded_number_of_jobs(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert CA._tasks(spark, 10) == n and CA._tasks(spark, CA.JOBS_PER_TASK * n * 7) == 7 * n
