"""Streams equal their batch twins; redelivery is harmless; fan-out isolates channels."""

import datetime as dt
import os

import numpy as np

from quayside.operators import ledger as LG
from quayside.operators import notify as NT
from quayside.sources import events as EV
from quayside.streaming import jobs as SJ
from quayside.streaming.stock_index import StockIndex

T0 = dt.datetime(2024, 1, 1)


def test_stream_ledger_over_micro_batches_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 5)), T0 + dt.timedelta(minutes=i), i, int(rng.integers(-50, 40)))
            for i in range(400)]
    schema = "product_id long, ts timestamp, event_id long, delta long"
    src = tmp_path / "src"
    # four files in time order -> four micro-batches with maxFilesPerTrigger=1
    for part in range(4):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], schema).coalesce(1) \
            .write.parquet(str(src / f"part={part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(str(src))
    run = str(tmp_path / "run")
    SJ.run_available_now(stream, run + "/ckpt", sink=SJ.stock_ledger_sink(run + "/out", 20, compact_every=2))
    got = {r.event_id: (r.balance, r.accepted) for r in spark.read.parquet(run + "/out/rows").collect()}
    batch = LG.ledger(spark.createDataFrame(rows, schema), None, default_opening=20)
    want = {r.event_id: (r.balance, r.accepted) for r in batch.collect()}
    assert got == want and len(got) == 400


def test_dedup_keeps_late_first_deliveries(spark, tmp_path):
    """One file per batch; a first delivery that comes nine hours late stays, a
    repeat in a later batch and one in the same batch go."""
    rows = [[(1, T0, "a")], [(2, T0 + dt.timedelta(hours=10), "b"), (2, T0 + dt.timedelta(hours=10), "b")],
            [(3, T0 + dt.timedelta(hours=20), "c"), (1, T0, "a")], [(4, T0 + dt.timedelta(hours=1), "late")],
            [(5, T0 + dt.timedelta(hours=21), "e"), (4, T0 + dt.timedelta(hours=1), "late")]]
    schema = "event_id long, ts timestamp, v string"
    src = tmp_path / "ev"
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(src / f"p={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(str(src))
    run = str(tmp_path / "run")
    SJ.run_available_now(stream, run + "/ckpt", sink=SJ.dedup_sink(run + "/out", ["event_id"]))
    assert sorted(r.event_id for r in spark.read.parquet(run + "/out").collect()) == [1, 2, 3, 4, 5]
    # a batch that is tried again writes the same rows once
    SJ.dedup_sink(run + "/out", ["event_id"])(spark.createDataFrame(rows[4], schema), 4)
    assert sorted(r.event_id for r in spark.read.parquet(run + "/out").collect()) == [1, 2, 3, 4, 5]


def test_events_without_a_sequence_alert_each(spark, tmp_path):
    """Five low-stock events of one product, as the product sink writes them and
    without sequence numbers: five alerts, and five after a redelivery."""
    ev = spark.createDataFrame(
        [("STOCK_ADJUSTED", "1", "SKU-1", "C", 5 - k, -1, None, T0 + dt.timedelta(minutes=k)) for k in range(5)],
        "eventType string, productId string, sku string, category string, stockQuantity int, stockDelta int, "
        "price decimal(12,2), occurredAt timestamp")
    topic, run = str(tmp_path / "topic"), str(tmp_path / "run")
    for _ in range(2):
        EV.write_topic(EV.product_event_records(ev), topic)
        src = EV.read_keyed_topic(spark, topic, "product.events", stream=True)
        SJ.run_available_now(src, run + "/ckpt", sink=SJ.low_stock_sink(run + "/alerts"))
        got = spark.read.parquet(run + "/alerts").collect()
        assert len(got) == len({r.id for r in got}) == 5


def test_low_stock_stream_redelivery_alerts_once(spark, tmp_path):
    ev = spark.createDataFrame(
        [("STOCK_ADJUSTED", "1", "SKU-1", "C", 3, -2, None, T0, 11),
         ("STOCK_ADJUSTED", "1", "SKU-1", "C", 3, -2, None, T0, 11),   # redelivered
         ("STOCK_ADJUSTED", "1", "SKU-1", "C", 30, -2, None, T0, 12),
         ("STOCK_ADJUSTED", "2", "SKU-2", "C", 0, None, None, T0, 13),  # null delta never alerts
         ("PRODUCT_CREATED", "3", "SKU-3", "C", 0, None, None, T0, 14)],
        "eventType string, productId string, sku string, category string, stockQuantity int, stockDelta int, "
        "price decimal(12,2), occurredAt timestamp, eventSeq long")
    topic = str(tmp_path / "topic")
    EV.write_records(ev, topic, "productId", ("occurredAt", "eventSeq"))
    src = EV.read_topic(spark, topic, "product.events", stream=True, max_files_per_trigger=1)
    run = str(tmp_path / "run")
    SJ.run_available_now(src, run + "/ckpt", sink=SJ.low_stock_sink(run + "/alerts"))
    got = spark.read.parquet(run + "/alerts").collect()
    assert [(r.sku, r.severity) for r in got] == [("SKU-1", "WARNING")]


def test_fanout_isolates_failing_channel(spark, tmp_path):
    alerts = spark.createDataFrame([("a", "LOW_STOCK", "CRITICAL", 1, "S", "t", "m", T0)],
                                   "id string, type string, severity string, product_id long, sku string, "
                                   "title string, message string, occurred_at timestamp")
    calls = []

    def broken(df, batch_id):
        calls.append("broken")
        raise RuntimeError("webhook down")

    log_path, hook_path = str(tmp_path / "log"), str(tmp_path / "hook")
    errors = NT.fanout([NT.log_channel(log_path), broken, NT.webhook_channel(hook_path)])(alerts, 0)
    assert errors == ["webhook down"] and calls == ["broken"]
    assert spark.read.parquet(log_path).count() == 1 and spark.read.parquet(hook_path).count() == 1
    assert os.path.exists(log_path)


def test_daily_demand_stream_matches_batch(spark, tmp_path):
    from quayside.operators import forecast as FC
    rows = [(p, T0 + dt.timedelta(hours=7 * i + p), (i % 5) + 1) for i in range(60) for p in (1, 2)]
    schema = "product_id long, occurred_at timestamp, quantity int"
    src = tmp_path / "items"
    for part in range(3):
        spark.createDataFrame(rows[part * 40:(part + 1) * 40], schema).coalesce(1).write.parquet(str(src / f"p={part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", "true").parquet(str(src))
    run = str(tmp_path / "run")
    SJ.run_available_now(stream, run + "/ckpt", sink=SJ.daily_demand_sink(run + "/out"))
    got = {(r.product_id, r.ds): r.y for r in SJ.daily_demand_total(spark.read.parquet(run + "/out")).collect()}
    want = {(r.product_id, r.ds): r.y for r in FC.daily_demand(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_indexed_forecast_alerts_carry_stock_across_batches(spark, tmp_path):
    from decimal import Decimal
    pschema = ("eventType string, productId string, sku string, category string, stockQuantity int, "
               "stockDelta int, price decimal(12,2), occurredAt timestamp, eventSeq long")
    fschema = ("eventType string, jobId string, productId string, sku string, status string, "
               "totalPredictedDemand decimal(18,2), mae decimal(10,4), errorMessage string, occurredAt timestamp")
    prod, fc = tmp_path / "p", tmp_path / "f"
    # batch 1: stock 40 at 08:00; batch 2: forecast at 09:00 (total 90 > 2 x 40 -> surge)
    spark.createDataFrame([("STOCK_ADJUSTED", "7", "SKU-7", "C", 40, -5, None, T0 + dt.timedelta(hours=8), 1)],
                          pschema).write.json(str(prod / "b1"))
    # the forecast folder must exist for the stream to start: an empty first file
    spark.createDataFrame([], fschema).write.json(str(fc / "b0"))
    run = str(tmp_path / "run")

    def run_once():
        p_src = spark.readStream.schema(pschema).option("recursiveFileLookup", "true").json(str(prod))
        f_src = spark.readStream.schema(fschema).option("recursiveFileLookup", "true").json(str(fc))
        SJ.run_available_now(SJ.both_topics(p_src, f_src), run + "/ckpt", sink=SJ.indexed_alert_sink(run + "/out", run + "/stock"))

    run_once()                       # first run: only the stock change, stored
    spark.createDataFrame([("FORECAST_COMPLETED", "j1", "7", "SKU-7", "COMPLETED", Decimal("90.00"), None, None,
                            T0 + dt.timedelta(hours=9)),
                           ("FORECAST_COMPLETED", "j2", "8", "SKU-8", "COMPLETED", Decimal("150.00"), None, None,
                            T0 + dt.timedelta(hours=9))], fschema).write.json(str(fc / "b2"))
    run_once()                       # restart from the checkpoint: the forecast meets the stored stock
    got = {(r.sku, r.type): r.message for r in spark.read.parquet(run + "/out").collect()}
    assert set(got) == {("SKU-7", "DEMAND_SURGE")}  # SKU-8 falls back to stock 100: 150 < 200
    assert "current stock is only 40 units" in got[("SKU-7", "DEMAND_SURGE")]


def test_stream_ledger_restores_order_inside_a_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(int(rng.integers(0, 3)), T0 + dt.timedelta(minutes=i), i, int(rng.integers(-40, 30)))
            for i in range(300)]
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    schema = "product_id long, ts timestamp, event_id long, delta long"
    src = str(tmp_path / "src")
    spark.createDataFrame(shuffled, schema).repartition(3).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    run = str(tmp_path / "run")
    SJ.run_available_now(stream, run + "/ckpt", sink=SJ.stock_ledger_sink(run + "/out", 15))
    got = {r.event_id: (r.balance, r.accepted) for r in spark.read.parquet(run + "/out/rows").collect()}
    batch = LG.ledger(spark.createDataFrame(rows, schema), None, default_opening=15)
    assert got == {r.event_id: (r.balance, r.accepted) for r in batch.collect()}


def test_topic_reader_accepts_every_instant_form(spark, tmp_path):
    p = tmp_path / "topic"
    p.mkdir()
    (p / "a.json").write_text("\n".join(
        '{"eventType":"STOCK_ADJUSTED","productId":"%d","occurredAt":"%s"}' % (i, ts)
        for i, ts in enumerate(["2024-01-01T00:00:00Z", "2024-01-01T00:00:07.1Z",
                                "2024-01-01T00:00:07.123Z", "2024-01-01T00:00:07.179575Z"])) + "\n")
    got = sorted((int(r.productId), r.occurredAt) for r in EV.read_topic(spark, str(p), "product.events").collect())
    assert [t for _, t in got] == [T0.replace(hour=0) + dt.timedelta(seconds=s)
                                   for s in (0, 7.1, 7.123, 7.179575)]


def test_indexed_forecast_alerts_of_late_and_unordered_files(spark, tmp_path):
    """Stock changes out of order over many micro-batches, then the forecasts,
    older than the newest stock and most beyond the two days kept: each meets the
    stock as of its own time."""
    from decimal import Decimal
    from quayside.operators import alerts as AL
    pschema = ("eventType string, productId string, sku string, category string, stockQuantity int, "
               "stockDelta int, price decimal(12,2), occurredAt timestamp, eventSeq long")
    fschema = ("eventType string, jobId string, productId string, sku string, status string, "
               "totalPredictedDemand decimal(18,2), mae decimal(10,4), errorMessage string, occurredAt timestamp")
    rng = np.random.default_rng(11)
    changes = [("STOCK_ADJUSTED", str(p), f"SKU-{p}", "C", int(rng.integers(5, 400)), -1, None,
                T0 + dt.timedelta(hours=int(h)), 1000 * p + n)
               for p in range(4) for n, h in enumerate(rng.integers(10, 200, 60))]
    changes = [changes[i] for i in rng.permutation(len(changes))]
    wanted = [("FORECAST_COMPLETED", f"j{p}-{n}", str(p), f"SKU-{p}", "COMPLETED", Decimal(int(rng.integers(10, 600))), None, None,
               T0 + dt.timedelta(hours=int(h))) for p in range(4) for n, h in enumerate(rng.integers(0, 210, 40))]
    prod, fc, run = tmp_path / "p", tmp_path / "f", str(tmp_path / "run")
    for k in range(4):
        spark.createDataFrame(changes[k * 60:(k + 1) * 60], pschema).coalesce(1).write.json(str(prod / f"b{k}"))
    for k, part in enumerate(([], wanted[:100], wanted[100:])):
        spark.createDataFrame(part, fschema).coalesce(1).write.json(str(fc / f"b{k}"))
        p_src, f_src = (spark.readStream.schema(x).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).json(str(d))
                        for x, d in ((pschema, prod), (fschema, fc)))
        SJ.run_available_now(SJ.both_topics(p_src, f_src), run + "/ckpt",
                             sink=SJ.indexed_alert_sink(run + "/out", run + "/stock", retention_days=2))
    got = sorted((r.product_id, r.type, r.message, r.occurred_at) for r in spark.read.parquet(run + "/out").collect())
    rows = []
    for _, job, p, sku, status, total, _, error, at in wanted:
        known = [(c[7], c[8], c[4]) for c in changes if c[1] == p and c[7] <= at]
        rows.append((job, int(p), sku, status, total, error, at, max(known)[2] if known else 100))
    want = AL.forecast_alerts(spark.createDataFrame(
        rows, "job_id string, product_id long, sku string, status string, total_predicted_demand decimal(18,2), "
              "error_message string, occurred_at timestamp_ntz, current_stock int"))
    assert got == sorted((r.product_id, r.type, r.message, r.occurred_at) for r in want.collect())
    assert len(got) > 20


def files_of(df):
    return sorted(df.inputFiles())


def _changes(rng, n, days, products=3):
    return [(int(rng.integers(0, products)), T0 + dt.timedelta(hours=int(h)), int(rng.integers(0, 3)), int(rng.integers(0, 500)))
            for h in rng.integers(0, 24 * days, n)]


CHANGES = "product_id long, ts timestamp_ntz, seq long, stock long"
EVENTS = "job_id string, product_id long, occurred_at timestamp_ntz"


def _as_of(changes, p, t):
    known = [(c[1], c[2], c[3]) for c in changes if c[0] == p and c[1] <= t]
    return max(known)[2] if known else 100


def test_stock_index_equals_brute_force_and_stays_small(spark, tmp_path):
    """Batches of changes out of order; after each, look-ups at any time. The marks
    beyond the retention are folded into the base, late changes included."""
    rng = np.random.default_rng(4)
    index, known = StockIndex(spark, str(tmp_path / "ix"), retention_days=3), []
    # distinct (product, ts, seq), so the last change is defined
    pool = list({c[:3]: c for c in _changes(rng, 260, 12)}.values())
    pool.sort(key=lambda c: c[1] + dt.timedelta(days=float(rng.normal(0, 2))))
    for k in range(4):
        part = pool[k * 60:(k + 1) * 60]
        known += part
        touched = index.extend(spark.createDataFrame(part, CHANGES), k)
        assert touched == sorted({c[1].date() for c in part})
        asked = [(f"{k}-{i}", int(rng.integers(0, 4)), T0 + dt.timedelta(hours=float(h))) for i, h in enumerate(rng.uniform(-5, 300, 40))]
        got = index.as_of(spark.createDataFrame(asked, EVENTS), k, touched)
        assert {r.job_id: r.current_stock for r in got.collect()} == {j: _as_of(known, p, t) for j, p, t in asked}
        index.fold(k, touched)
        newest, horizon, base = index.state(k + 1)
        assert newest == max(c[1].date() for c in known) and horizon == newest - dt.timedelta(days=3)
        # one row per product before the horizon, and a mark per product and day after it
        rows = {r.product_id: (r.ts, r.seq, r.stock) for r in index._base(base).collect()}
        assert rows == {p: max((c[1], c[2], c[3]) for c in known if c[0] == p and c[1].date() < horizon)
                        for p in {c[0] for c in known if c[1].date() < horizon}}


def test_stock_index_lists_only_the_days_it_needs(spark, tmp_path):
    rng = np.random.default_rng(5)
    index = StockIndex(spark, str(tmp_path / "ix"), retention_days=3)
    changes = list({c[:3]: c for c in _changes(rng, 400, 30)}.values())
    index.fold(0, index.extend(spark.createDataFrame(changes, CHANGES), 0))
    _, horizon, _ = index.state(1)
    day = horizon + dt.timedelta(days=1)
    days = {(p.split("/ix/")[1].split("/")[0], *(x for x in p.split("/") if x.startswith("day=")))
            for p in files_of(index.tables_of([day], 1, []))}
    assert days == {("history", f"day={day}"), ("marks", f"day={horizon}"), ("base",)}
    # whole history of a product is in no plan: the stored rows read are a fraction
    assert index.tables_of([day], 1, []).count() < len(changes) / 5


def test_stock_index_batch_again_changes_nothing(spark, tmp_path):
    rng = np.random.default_rng(6)
    index = StockIndex(spark, str(tmp_path / "ix"), retention_days=2)
    pool = list({c[:3]: c for c in _changes(rng, 120, 9)}.values())
    asked = spark.createDataFrame([(f"{i}", int(i % 3), T0 + dt.timedelta(hours=7 * i)) for i in range(30)], EVENTS)
    seen = []
    for k, part in ((0, pool[:60]), (1, pool[60:]), (1, pool[60:])):
        touched = index.extend(spark.createDataFrame(part, CHANGES), k)
        got = sorted(map(tuple, index.as_of(asked, k, touched).select("job_id", "product_id", "occurred_at", "current_stock").collect()))
        index.fold(k, touched)
        state = index.state(k + 1)
        seen.append((got, state, sorted(map(tuple, index._base(state[2]).collect()))))
    assert seen[1] == seen[2]
    assert [r[3] for r in seen[2][0]] == [_as_of(pool, r[1], r[2]) for r in seen[2][0]]
    # an empty batch, and look-ups in an empty index
    assert index.extend(spark.createDataFrame([], CHANGES), 2) == []
    index.fold(2, [])
    assert index.state(3) == state
    none = StockIndex(spark, str(tmp_path / "none"))
    assert {r.current_stock for r in none.as_of(asked, 0).collect()} == {100}


def test_ledger_store_goes_on_from_committed_balances(spark, tmp_path):
    """Seven batches, one product with a third of all rows over several chunks; a
    batch that is tried again gives the rows it gave; snapshots are used."""
    rng = np.random.default_rng(8)
    rows = [(0 if rng.random() < 0.34 else int(rng.integers(1, 6)), T0 + dt.timedelta(minutes=i), i, int(rng.integers(-50, 40))) for i in range(700)]
    schema = "product_id long, ts timestamp, event_id long, delta long"
    store = SJ.LedgerStore(str(tmp_path / "l"), 20, compact_every=3)
    for k in (0, 1, 2, 3, 3, 4, 5, 6, 2, 6):
        store.apply(spark.createDataFrame(rows[k * 100:(k + 1) * 100], schema).repartition(3), k)
    got = {r.event_id: (r.balance_before, r.balance, r.accepted) for r in spark.read.parquet(str(tmp_path / "l/rows")).collect()}
    want = LG.ledger(spark.createDataFrame(rows, schema), None, default_opening=20)
    assert got == {r.event_id: (r.balance_before, r.balance, r.accepted) for r in want.collect()} and len(got) == 700
    last = {r.product_id: r.opening for r in store.balances(spark, "bigint", 7).collect()}
    assert last == {r.product_id: r.balance for r in LG.final_balances(want).collect()}
    assert sorted(x for x in os.listdir(tmp_path / "l/snapshots") if "=" in x) == ["batch_id=2", "batch_id=5"]


def test_a_failed_channel_gets_its_alerts_later_and_the_others_once(spark, tmp_path):
    """Low-stock stream of three batches; the webhook fails in the second. In the end
    every alert came once per channel."""
    taken = {"log": [], "webhook": []}
    state = {"calls": 0}

    def channel(name):
        def send(alerts, batch_id):
            state["calls"] += name == "webhook"
            if name == "webhook" and state["calls"] == 2:
                raise RuntimeError("webhook down")
            taken[name] += [(r.id, batch_id) for r in alerts.select("id").collect()]
        return send

    outbox = NT.Outbox(str(tmp_path / "outbox"), {"log": channel("log"), "webhook": channel("webhook")})
    schema = ("eventType string, productId string, sku string, category string, stockQuantity int, stockDelta int, "
              "price decimal(12,2), occurredAt timestamp, eventSeq long")
    src = tmp_path / "src"
    for k in range(3):
        rows = [("STOCK_ADJUSTED", str(p), f"SKU-{p}", "C", 3, -2, None, T0 + dt.timedelta(days=k), k) for p in range(4)]
        rows += [("STOCK_ADJUSTED", "0", "SKU-0", "C", 3, -2, None, T0, 0)]  # a redelivery
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(src / f"b={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(src))
    run = str(tmp_path / "run")
    SJ.run_available_now(stream, run + "/ckpt", sink=SJ.low_stock_sink(run + "/alerts", outbox=outbox))
    stored = {r.id for r in spark.read.parquet(run + "/alerts").collect()}
    assert len(stored) == 12
    for name in taken:
        assert sorted(i for i, _ in taken[name]) == sorted(stored), name
    assert [b for _, b in taken["webhook"]] == sorted(b for _, b in taken["webhook"])  # oldest first
    assert outbox.pending(spark) == {"log": [], "webhook": []} and outbox.deliver(spark) == {}
    ledger = spark.read.parquet(str(tmp_path / "outbox/delivered"))
    assert ledger.count() == 24 and ledger.select("channel", "id").distinct().count() == 24


def test_outbox_isolates_a_channel_that_stays_down(spark, tmp_path):
    alerts = spark.createDataFrame([("a",), ("b",)], "id string")

    def down(df, batch_id):
        raise RuntimeError("down")

    outbox = NT.Outbox(str(tmp_path / "o"), {"down": down, "up": lambda df, k: df.count()})
    for k in range(2):
        outbox.commit(alerts, k)
        outbox.commit(alerts, k)  # the batch is tried again
        assert outbox.deliver(spark) == {"down": "down"}
    assert outbox.pending(spark) == {"down": [0, 1], "up": []}
