"""Stock ledger: the reference's examples and a brute-force loop on random
sequences, with hot products split over many chunks."""

import datetime as dt

import numpy as np
import pytest

from quayside.operators import ledger as LG


def brute(start, deltas):
    b, out = start, []
    for d in deltas:
        ok = b + d >= 0
        if ok:
            b += d
        out.append((b, ok))
    return out


def frame(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [(p, t0 + dt.timedelta(seconds=i), i, d) for i, (p, d) in enumerate(rows)]
    return spark.createDataFrame(data, "product_id long, ts timestamp, event_id long, delta long")


@pytest.mark.parametrize("start,delta,balance,accepted", [
    (10, 5, 15, True), (10, -3, 7, True), (5, -5, 0, True), (3, -4, 3, False), (50, -5, 45, True),
    (100, -30, 70, True),
])
def test_single_delta(spark, start, delta, balance, accepted):
    op = spark.createDataFrame([(1, start)], "product_id long, opening long")
    r = LG.ledger(frame(spark, [(1, delta)]), op).collect()[0]
    assert (r.balance, r.accepted) == (balance, accepted)
    if not accepted:
        assert r.message == f"Cannot reduce stock below zero. Current: {start}, Delta: {delta}"
    else:
        assert r.message is None


def end_of(parts, start):
    """Where a start ends by the functions of a run's parts."""
    for lo, shift in parts:
        j = int(np.searchsorted(lo, start, side="right")) - 1
        assert j >= 0
        start += int(shift[j])
    return start


def test_transfer_function_is_exact():
    rng = np.random.default_rng(7)
    for _ in range(300):
        d = rng.integers(-40, 30, size=rng.integers(1, 40))
        parts = LG._summary(d, 0, 1 << 40)
        for b in range(0, 200):
            assert end_of(parts, b) == brute(b, d.tolist())[-1][0]


@pytest.mark.parametrize("chunks", [1, 3, 8])
def test_random_sequences_match_loop(spark, chunks):
    rng = np.random.default_rng(chunks)
    rows = []
    for i in range(600):
        # product 0 is hot: about a third of all rows
        p = 0 if rng.random() < 0.34 else int(rng.integers(1, 12))
        rows.append((p, int(rng.integers(-60, 50))))
    opening = {p: int(rng.integers(0, 100)) for p in range(12)}
    op = spark.createDataFrame(list(opening.items()), "product_id long, opening long")
    got = LG.ledger(frame(spark, rows), op, num_chunks=chunks).orderBy("event_id").collect()
    want = {}
    for p in range(12):
        idx = [i for i, (q, _) in enumerate(rows) if q == p]
        for i, res in zip(idx, brute(opening[p], [rows[i][1] for i in idx])):
            want[i] = res
    assert len(got) == len(rows)
    for r in got:
        assert (r.balance, r.accepted) == want[r.event_id], r


def test_hot_product_spans_chunks(spark):
    rows = [(0, -5 if i % 3 == 0 else 2) for i in range(900)]
    got = LG.ledger(frame(spark, rows), None, default_opening=3, num_chunks=6)
    chunked = got.orderBy("event_id").collect()
    want = brute(3, [d for _, d in rows])
    assert [(r.balance, r.accepted) for r in chunked] == want


def test_runs_split_across_arrow_batches(spark):
    """Tiny Arrow batches cut every product's run; carries must keep it exact."""
    rng = np.random.default_rng(11)
    rows = [(int(rng.integers(0, 4)), int(rng.integers(-30, 25))) for _ in range(500)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = LG.ledger(frame(spark, rows), None, default_opening=10, num_chunks=3).orderBy("event_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = {}
    for p in range(4):
        idx = [i for i, (q, _) in enumerate(rows) if q == p]
        for i, res in zip(idx, brute(10, [rows[i][1] for i in idx])):
            want[i] = res
    assert [(r.balance, r.accepted) for r in got] == [want[i] for i in range(len(rows))]
    assert all(r.balance_before + (r.delta if r.accepted else 0) == r.balance for r in got)


@pytest.mark.parametrize("width", [1, 7, 40, 5000])
def test_windowed_transfer_matches_loop(width):
    rng = np.random.default_rng(width)
    for _ in range(40):
        d = rng.integers(-35, 30, size=int(rng.integers(1, 300)))
        a = int(rng.integers(0, 60))
        parts = LG._summary(d, a, a + width)
        assert parts[0][0][0] == a
        for b in list(range(a, a + min(width, 80))) + [a + width - 1]:
            assert end_of(parts, b) == brute(b, d.tolist())[-1][0]


def test_reflected_window_holds_true_balance():
    """The refusal ledger stays within [reflected, reflected + largest negative step)."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        d = rng.integers(-40, 35, size=200).tolist()
        s = int(rng.integers(0, 30))
        b, r, w = s, s, 0
        for x in d:
            b = b + x if b + x >= 0 else b
            r = max(0, r + x)
            w = max(w, -x)
            assert r <= b < r + max(1, w)


def test_final_balances(spark):
    rows = [(1, 5), (1, -20), (2, 3), (1, -4)]
    led = LG.ledger(frame(spark, rows), None, default_opening=10)
    got = {r.product_id: (r.balance, r.n_deltas, r.n_refused) for r in LG.final_balances(led).collect()}
    assert got == {1: (11, 3, 1), 2: (13, 1, 0)}


def test_shuffle_join_path_when_tables_are_large(spark):
    """Without broadcasts: shuffle join + sort within partitions."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    rng = np.random.default_rng(23)
    rows = [(0 if rng.random() < 0.4 else int(rng.integers(1, 6)), int(rng.integers(-30, 25))) for _ in range(700)]
    try:
        got = LG.ledger(frame(spark, rows), None, default_opening=20, num_chunks=5).orderBy("event_id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    want = {}
    for p in range(6):
        idx = [i for i, (q, _) in enumerate(rows) if q == p]
        for i, res in zip(idx, brute(20, [rows[i][1] for i in idx])):
            want[i] = res
    assert [(r.balance, r.accepted) for r in got] == [want[i] for i in range(len(rows))]


def test_transfer_property():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.integers(-60, 50), min_size=1, max_size=80), st.integers(0, 40),
           st.sampled_from([1, 3, 17, 5000]), st.sampled_from([1, 4, 64]))
    def check(deltas, a, width, budget):
        parts = LG._summary(np.array(deltas, dtype=np.int64), a, a + width, budget)
        for b in range(a, a + min(width, 60)):
            assert end_of(parts, b) == brute(b, deltas)[-1][0]

    check()


def test_wide_windows_are_summarised_in_parts():
    """The parts one after another give every start the end that replaying gives it."""
    rng = np.random.default_rng(12)
    for budget in (1, 3, 64):
        for width in (1, 50, 5000, 20_000):
            d = rng.integers(-400, 390, 600)
            d[rng.integers(0, 600, 3)] = -9000
            a = int(rng.integers(0, 50))
            parts = LG._summary(d, a, a + width, budget)
            for start in {a, a + width - 1, *rng.integers(a, a + width, 25).tolist()}:
                assert end_of(parts, start) == LG.replay(start, d)[0][-1], (budget, width, start)


def test_summary_of_a_wide_window_grows_with_the_deltas_only():
    import time
    rng = np.random.default_rng(13)
    sizes, seconds = [], []
    for n in (20_000, 80_000):
        d = rng.integers(-50, 50, n)
        t = time.perf_counter()
        parts = LG._summary(d, 0, 1_000_000)
        seconds.append(time.perf_counter() - t)
        sizes.append(sum(len(lo) for lo, _ in parts))
    assert sizes[1] <= 80_000 and seconds[1] < 3, (sizes, seconds)


def test_ledger_with_a_huge_delta_matches_a_loop(spark):
    """A window of a million balances in every later chunk."""
    rng = np.random.default_rng(14)
    d = rng.integers(-50, 49, 4000)
    d[5], d[900] = 1_000_000, -1_000_001
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(seconds=i), i, int(x)) for i, x in enumerate(d)]
    out = LG.ledger(spark.createDataFrame(rows, "product_id long, ts timestamp, event_id long, delta long"), None, default_opening=3, num_chunks=6)
    got = {r.event_id: (r.balance, r.accepted) for r in out.collect()}
    bal, ok = LG.replay(3, d)
    assert got == {i: (int(bal[i]), bool(ok[i])) for i in range(len(d))}


def test_openings_that_turn_into_a_broadcast_at_run_time(spark):
    """Products over many chunks with openings whose size is known at run time only:
    the fold has to see all chunks of a product, in order, in one partition."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    rng = np.random.default_rng(3)
    rows = [(p, int(d)) for d3 in rng.integers(-9, 9, (3000, 3)) for p, d in zip((1, 2, 3), d3)]
    deltas = frame(spark, rows).repartition(4)
    opening = deltas.select("product_id").distinct().selectExpr("product_id", "product_id * 100 AS opening").where("product_id < 3")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {(r.product_id, r.event_id): (r.balance, r.accepted) for r in LG.ledger(deltas, opening, default_opening=7, num_chunks=16).collect()}
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for p, start in ((1, 100), (2, 200), (3, 7)):
        own = [(i, d) for i, (q, d) in enumerate(rows) if q == p]
        assert [got[(p, i)] for i, _ in own] == brute(start, [d for _, d in own])
