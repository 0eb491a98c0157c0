"""Physical plan properties the scale design relies on (guards against regressions)."""

import re

import pytest

from quayside.operators import forecast as FC
from quayside.plans import catalog as CA

BASE = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern: str, text: str) -> int:
    return len(re.findall(pattern, text))


@pytest.fixture(autouse=True)
def no_adaptive(spark):
    # the static plan shows every exchange; AQE would wrap it in stages
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", old)


def test_forecast_fit_uses_two_exchanges_and_one_sort(spark):
    p = plan(CA.q_forecast_points(spark, BASE))
    # (product, day) after the map-side partial aggregate, then product
    assert count(r"Exchange hashpartitioning", p) == 2
    assert count(r"\bSort \[", p) == 1
    assert "partial_sum" in p


def test_scans_are_pruned_and_filtered(spark):
    p = plan(CA.history(spark, BASE))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in p
    assert re.search(r"PushedFilters: \[[^\]]*Not\(EqualTo\(o_orderstatus,P\)\)", p)


def test_top1_per_product_is_aggregated_before_the_shuffle(spark):
    p = plan(CA.q_latest_forecast(spark, BASE))
    assert "partial_min" in p and "Window" not in p.split("partial_min")[0]


def test_item_forecasts_explode_distinct_pairs_only(spark):
    """30-row histories are made of the distinct (quantity, day) pairs; items meet the
    checkpointed models of the pairs."""
    items = CA.confirmed_order_items(spark, BASE)
    p = plan(FC.seed_models(items, CA.ITEM_KEYS))
    assert "Generate explode(sequence(date" not in p and count("Window", p) == 0
    assert count(r"Scan ExistingRDD", p) == 1


def test_seed_histories_shuffle_items_not_exploded_rows(spark):
    keys = CA.ITEM_KEYS
    items = CA.confirmed_order_items(spark, BASE)
    p = plan(FC.fit(FC.seed_history(items, keys), keys))
    # the exchange on the series key sits below the explode (Generate)
    ex = p.find("Exchange hashpartitioning(order_id")
    gen = p.find("Generate explode")
    assert ex > gen > 0   # tree text: the parent (Generate) is printed before its child


def test_lifecycle_events_are_shuffled_once(spark):
    from quayside.operators import lifecycle as LC
    from quayside.sources import fixtures as FX
    final, verdicts = LC.order_lifecycle(FX.order_lifecycle_events(spark, BASE))
    # verdicts read the checkpointed chunks; the only exchange is that of the chunks' edge rows
    p = plan(verdicts)
    assert count(r"Exchange hashpartitioning\(_k0", p) == 1 and count("SortMergeJoin", p) == 0 and count("FileScan", p) == 0
    # final states: one more exchange, of rows that are aggregated before it
    p = plan(final)
    assert count(r"Exchange hashpartitioning\(_k0", p) == 2 and "partial_max_by" in p


def test_item_keys_need_no_per_order_sort(spark):
    p = plan(CA.confirmed_order_items(spark, BASE))
    assert "Window" not in p and "partial_count" in p


def test_points_of_a_job_are_not_moved_one_by_one(spark):
    """Jobs with their points, and their views: the items' rows are dealt out by job
    before a point is made, and no exchange moves an item's points."""
    for q in (CA.q_jobs_with_points, CA.q_forecast_job_view):
        p = plan(q(spark, BASE))
        # exchanges on job_id are those of rows dealt out, none is Spark's own
        assert count(r"Exchange hashpartitioning\(job_id[^\n]*REPARTITION_BY_NUM", p) == 2
        assert count(r"Exchange hashpartitioning\(job_id[^\n]*ENSURE_REQUIREMENTS", p) == 0


def test_jobs_are_dealt_out_before_they_are_reduced_or_explode(spark):
    assert count(r"Exchange hashpartitioning\(id[^\n]*REPARTITION_BY_NUM", plan(CA.q_latest_forecast(spark, BASE))) == 1
    p = plan(CA.q_validate_points(spark, BASE))
    assert count(r"Exchange hashpartitioning\(job_id[^\n]*REPARTITION_BY_NUM", p) == 1


def test_seed_pairs_are_taken_from_cheaper_rows(spark):
    """With ``seeds`` the items are not keyed a second time for their pairs."""
    rows, items = CA.confirmed_order_rows(spark, BASE), CA.confirmed_order_items(spark, BASE)
    nothing = items.where("false")
    got = FC.seed_models(items, CA.ITEM_KEYS, seeds=rows)
    want = FC.seed_models(items, CA.ITEM_KEYS)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not got.isEmpty()
    # the pairs come from the seeds alone
    assert FC.seed_models(items, CA.ITEM_KEYS, seeds=rows.where("false")).isEmpty() and FC.seed_models(nothing, CA.ITEM_KEYS, seeds=rows).isEmpty()


def test_an_upsert_of_jobs_reads_its_writes_once(spark):
    from quayside.sources import store as ST
    cols = "id string, product_id long, sku string, horizon_days int, status string, model_used string, mae decimal(10,4), error_message string, created_at timestamp_ntz, updated_at timestamp_ntz"
    stored = spark.createDataFrame([], cols + ", version long")
    incoming = spark.createDataFrame([], cols).repartition(3, "sku")
    assert count("REPARTITION_BY_NUM", plan(ST.upsert_forecast_jobs(stored, incoming))) == 1
