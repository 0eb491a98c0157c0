"""Skew probe for the stock ledger: one product holds a third of all deltas.

usage: python scripts/skew_probe.py [n_rows] [chunks]
Builds the inputs with spark.range (no driver-side data). Ledger: runs the
chunked ledger, reports how many chunks the hot product spans and the time,
and checks the hot product's balances against a plain loop. Lifecycle: one
order holds a third of all events; its replay is checked against a fold.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quayside.operators import ledger as LG  # noqa: E402
from quayside.operators import lifecycle as LC  # noqa: E402
from quayside.session import local_session  # noqa: E402


def main() -> None:
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    chunks = int(sys.argv[2]) if len(sys.argv) > 2 else 16
    spark = local_session(8, chunks, "quayside-skew-probe")
    h = F.xxhash64("id")
    deltas = spark.range(n).select(
        F.when(F.pmod(h, 3) == 0, F.lit(0)).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), 10000) + 1)
        .alias("product_id"),
        F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("event_id"),
        (F.pmod(F.xxhash64("id", F.lit(2)), 61) - 31).alias("delta"))
    t0 = time.perf_counter()
    out = LG.ledger(deltas, None, default_opening=50, num_chunks=chunks)
    out.write.format("noop").mode("overwrite").save()
    secs = time.perf_counter() - t0
    hot = out.where("product_id = 0").orderBy("ts", "event_id").select("delta", "balance", "accepted").toPandas()
    b, ok = 50, True
    for d, bal, acc in zip(hot["delta"].to_numpy(), hot["balance"].to_numpy(), hot["accepted"].to_numpy()):
        a = b + d >= 0
        b = b + d if a else b
        ok &= (bal == b) and (acc == a)
    spans = (deltas.repartitionByRange(chunks, "product_id", "ts", "event_id")
             .select("product_id", F.spark_partition_id().alias("p")).where("product_id = 0")
             .select("p").distinct().count())
    print({"rows": n, "hot_rows": len(hot), "chunks": chunks, "hot_product_partitions": spans,
           "seconds": round(secs, 2), "hot_matches_loop": bool(ok),
           "refused_hot": int((~hot["accepted"]).sum()), "np": np.__version__})

    acts = F.array(*[F.lit(a) for a in ("CONFIRM", "SHIP", "DELIVER", "CANCEL")])
    events = spark.range(n).select(
        F.when(F.pmod(F.xxhash64("id", F.lit(3)), 3) == 0, F.lit(0))
        .otherwise(F.pmod(F.xxhash64("id", F.lit(4)), 100000) + 1).alias("order_id"),
        F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").alias("event_id"),
        F.element_at(acts, (F.pmod(F.xxhash64("id", F.lit(5)), 4) + 1).cast("int")).alias("action"))
    t0 = time.perf_counter()
    final, verdicts = LC.order_lifecycle(events)
    final.write.format("noop").mode("overwrite").save()
    verdicts.write.format("noop").mode("overwrite").save()
    secs = time.perf_counter() - t0
    hot_final = final.where("order_id = 0").collect()[0]
    hot = events.where("order_id = 0").orderBy("ts", "event_id").select("action").toPandas()["action"]
    s, refused = "PENDING", 0
    for a in hot:
        t = LC.ORDER_MACHINE.moves.get(s, {}).get(a)
        refused += t is None
        s = t or s
    print({"events": n, "hot_events": len(hot), "seconds_final_and_verdicts": round(secs, 2),
           "hot_matches_fold": (hot_final.status, hot_final.n_refused) == (s, refused)})
    spark.stop()


if __name__ == "__main__":
    main()
