"""Order and forecast-job state machines: every legal and illegal move."""

import datetime as dt

import pytest

from quayside.operators import lifecycle as LC

T0 = dt.datetime(2024, 1, 1)


def events(spark, key, actions):
    rows = [(key, T0 + dt.timedelta(minutes=i), i, a) for i, a in enumerate(actions)]
    return rows


def run(spark, actions, machine=LC.ORDER_MACHINE, key="order_id"):
    df = spark.createDataFrame(events(spark, 1, actions), f"{key} long, ts timestamp, event_id long, action string")
    final, verdicts = LC.replay(df, machine, key=key)
    return final.collect()[0], verdicts.orderBy("event_id").collect()


# status reached by a prefix of legal moves
PREFIX = {"PENDING": [], "CONFIRMED": ["CONFIRM"], "SHIPPED": ["CONFIRM", "SHIP"],
          "DELIVERED": ["CONFIRM", "SHIP", "DELIVER"], "CANCELLED": ["CANCEL"]}
LEGAL = {("PENDING", "CONFIRM"): "CONFIRMED", ("PENDING", "CANCEL"): "CANCELLED",
         ("CONFIRMED", "SHIP"): "SHIPPED", ("CONFIRMED", "CANCEL"): "CANCELLED",
         ("SHIPPED", "DELIVER"): "DELIVERED"}
MESSAGES = {
    "CONFIRM": "Only PENDING orders can be confirmed. Current: {s}",
    "SHIP": "Only CONFIRMED orders can be shipped. Current: {s}",
    "DELIVER": "Only SHIPPED orders can be delivered. Current: {s}",
}


@pytest.mark.parametrize("state", list(PREFIX))
@pytest.mark.parametrize("action", ["CONFIRM", "SHIP", "DELIVER", "CANCEL"])
def test_every_pair(spark, state, action):
    final, verdicts = run(spark, PREFIX[state] + [action])
    last = verdicts[-1]
    assert last.status_before == state
    if (state, action) in LEGAL:
        assert last.accepted and last.status_after == LEGAL[(state, action)]
        assert final.status == LEGAL[(state, action)] and last.message is None
    else:
        assert not last.accepted and last.status_after == state and final.status == state
        if action == "CANCEL":
            want = "Order is already cancelled" if state == "CANCELLED" else \
                f"Cannot cancel an order that is already {state}"
        else:
            want = MESSAGES[action].format(s=state)
        assert last.message == want


def test_counts_and_refusals_in_a_long_history(spark):
    final, verdicts = run(spark, ["SHIP", "CONFIRM", "CONFIRM", "SHIP", "CANCEL", "DELIVER", "DELIVER"])
    assert final.status == "DELIVERED"
    assert (final.n_events, final.n_accepted, final.n_refused) == (7, 3, 4)
    assert [v.accepted for v in verdicts] == [False, True, False, True, False, True, False]


def test_job_machine(spark):
    final, v = run(spark, ["COMPLETE", "START", "START", "FAIL", "COMPLETE"], LC.JOB_MACHINE, "job_id")
    assert final.status == "FAILED"
    assert [x.message for x in v] == [
        "Only RUNNING jobs can be completed. Current: PENDING", None,
        "Only PENDING jobs can be started. Current: RUNNING", None,
        "Only RUNNING jobs can be completed. Current: FAILED"]


def test_versioned_update_first_wins(spark):
    table = spark.createDataFrame([(1, 0), (2, 3)], "id long, version long")
    upd = spark.createDataFrame([(1, 10, T0, 0), (1, 11, T0 + dt.timedelta(1), 0), (2, 12, T0, 2), (9, 13, T0, 0)],
                                "id long, update_id long, ts timestamp, version long")
    got = {r.update_id: (r.outcome, r.new_version) for r in LC.versioned_update(table, upd).collect()}
    assert got == {10: ("ACCEPTED", 1), 11: ("STALE", None), 12: ("STALE", None), 13: ("UNKNOWN_ID", None)}


def _fold(machine, actions):
    s, out = machine.start, []
    for a in actions:
        t = machine.moves.get(s, {}).get(a)
        out.append((s, t is not None))
        s = t or s
    return s, out


@pytest.mark.parametrize("machine,key,acts", [
    (LC.ORDER_MACHINE, "order_id", ["CONFIRM", "SHIP", "DELIVER", "CANCEL"]),
    (LC.JOB_MACHINE, "job_id", ["START", "COMPLETE", "FAIL"]),
])
def test_random_histories_match_fold(spark, machine, key, acts):
    import numpy as np
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        k = 0 if rng.random() < 0.34 else int(rng.integers(1, 60))   # key 0 is hot
        # equal timestamps happen: the event id breaks the tie
        rows.append((k, T0 + dt.timedelta(minutes=int(rng.integers(0, 400))), i, acts[int(rng.integers(len(acts)))]))
    df = spark.createDataFrame(rows, f"{key} long, ts timestamp, event_id long, action string")
    final, verdicts = LC.replay(df, machine, key=key)
    got_final = {r[key]: (r.status, r.n_events, r.n_refused) for r in final.collect()}
    got_v = {r.event_id: (r.status_before, r.accepted) for r in verdicts.collect()}
    for k in {r[0] for r in rows}:
        evs = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        status, out = _fold(machine, [r[3] for r in evs])
        assert got_final[k] == (status, len(evs), sum(1 for _, ok in out if not ok))
        for r, o in zip(evs, out):
            assert got_v[r[2]] == o


def by_hand(machine, rows):
    """Verdicts of (key, ts, seq, action) rows, one after another."""
    out = []
    first = lambda x: (x is not None, x)  # noqa: E731 - nulls first
    state = {}
    for k, t, i, a in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), first(r[2]), first(r[3]))):
        s = state.get(k, machine.start)
        to = machine.moves.get(s, {}).get(a)
        state[k] = to or s
        out.append((k, t, i, a, s, to is not None, to or s))
    return sorted(out, key=str), state


CIRCLE = LC.Machine(start="OFF", moves={"OFF": {"ON": "ON"}, "ON": {"OFF": "OFF", "ON": "ON"}}, refusal=LC._order_refusal)


@pytest.mark.parametrize("machine", [LC.ORDER_MACHINE, LC.JOB_MACHINE, CIRCLE])
@pytest.mark.parametrize("batch", [3, 10_000])
def test_chunks_compose_whatever_their_bounds(spark, machine, batch):
    """Many chunks, runs that span several of them and several Arrow batches, equal
    positions, repeated rows, unknown actions and nulls."""
    import random
    rng = random.Random(3)
    acts = [*dict.fromkeys(a for m in machine.moves.values() for a in m), "OTHER", None]
    rows = [(rng.choice([1, 1, 1, 1 << 60, (1 << 60) + 1, *range(2, 9), None]), rng.choice([None, *(T0 + dt.timedelta(minutes=m) for m in range(25))]),
             rng.choice([0, 0, 1, None]), rng.choice(acts)) for _ in range(600)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "order_id long, ts timestamp, event_id long, action string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        final, verdicts = LC.replay(df, machine, num_chunks=13)
        got = sorted(map(tuple, verdicts.select("order_id", "ts", "event_id", "action", "status_before", "accepted", "status_after").collect()), key=str)
        ends = {r.order_id: (r.status, r.n_events, r.n_accepted, r.n_refused, r.last_change) for r in final.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, state = by_hand(machine, rows)
    assert got == want
    for k, s in state.items():
        own = [r for r in want if r[0] == k]
        yes = [r[1] for r in own if r[5] and r[1] is not None]
        assert ends[k] == (s, len(own), sum(r[5] for r in own), sum(not r[5] for r in own), max(yes, default=None))
    assert len(ends) == len(state)


def test_an_event_delivered_twice_is_accepted_once(spark):
    df = spark.createDataFrame([(1, T0, 1, "CONFIRM"), (1, T0, 1, "CONFIRM"), (2, T0, 1, "SHIP"), (2, T0, 1, "CANCEL"), (2, T0, 0, "CONFIRM")],
                               "order_id long, ts timestamp, event_id long, action string")
    final, verdicts = LC.order_lifecycle(df)
    assert sorted((r.order_id, r.status, r.n_accepted) for r in final.collect()) == [(1, "CONFIRMED", 1), (2, "CANCELLED", 2)]
    assert sorted((r.order_id, r.action, r.accepted) for r in verdicts.collect()) == [
        (1, "CONFIRM", False), (1, "CONFIRM", True), (2, "CANCEL", True), (2, "CONFIRM", True), (2, "SHIP", False)]


def test_a_hot_order_is_replayed_by_many_tasks(spark):
    """A third of the events belong to one order: its verdicts come from many
    partitions of the final plan, none of which holds much more than its share."""
    from pyspark.sql import functions as F
    acts = F.array(*[F.lit(a) for a in ("CONFIRM", "SHIP", "DELIVER", "CANCEL")])
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("order_id"), F.timestamp_seconds("id").alias("ts"),
        F.col("id").alias("event_id"), F.element_at(acts, (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("int")).alias("action"))
    _, verdicts = LC.order_lifecycle(df, num_chunks=12)
    rows = verdicts.withColumn("task", F.spark_partition_id()).groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("order_id") == 0).alias("hot")).collect()
    assert sum(r.hot > 0 for r in rows) >= 4 and max(r.n for r in rows) <= 2 * 30_000 / 12


def test_empty_events(spark):
    final, verdicts = LC.order_lifecycle(spark.createDataFrame([], "order_id long, ts timestamp, event_id long, action string"))
    assert final.count() == 0 and verdicts.count() == 0
