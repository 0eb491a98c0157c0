"""Stock ledger: apply signed deltas in (time, sequence) order; a delta that
would take the balance below zero is refused and leaves it unchanged.

A refused delta changes every later balance, so this is not a running sum.
It is still split across tasks, hot products included, as a three-phase scan:

1. ``repartitionByRange(product, ts, seq)`` cuts the ordered deltas into
   chunks (one chunk = the run of one product inside one range partition), so
   a product holding a third of all rows spans many partitions. The tagged
   chunks are checkpointed to the shared checkpoint folder, which pins the
   chunk boundaries and cuts lineage for executor loss.
2. The reflected walk ``r = max(0, r + d)`` composes in parallel (a chunk
   maps a start s to ``max(s + total, m)``), and the refusal ledger always
   lies in ``[r, r + w)`` with w the largest negative step seen so far. A
   fold over one row per chunk gives every chunk's start window; each chunk
   is then summarised, in parallel, by its exact transfer function on that
   window only (``end = start + shift(start)``; a table of distinct balances
   for narrow windows; for wide ones sorted pieces, part by part under a budget
   of pieces; one piece when the window lies above the chunk's deficit). A second fold over the summaries gives
   each chunk's exact opening balance. Without the window a draining product
   would need one piece per delta.
3. Chunks are replayed in parallel from their opening balances: a vectorised
   cumulative sum when the opening covers the chunk's deficit, a plain loop
   over that chunk otherwise.

No step holds more than one chunk of raw rows, and the driver never sees rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import ensure_checkpoint_dir

# start windows up to this width are tabulated; wider ones use pieces
TABULATE_MAX_WIDTH = 4096
# chunk number of a product's opening balance: before its first chunk
OPENING = -1
# pieces of a transfer function after which a wide window is summarised anew
PIECES = 64


def _transfer_table(deltas: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """The exact transfer function of a run on a narrow window [a, b): ``(lo, shift)``,
    where a start s with lo[j] <= s < lo[j+1] ends at s + shift[j]. A table of the distinct
    balances reached from every start in [a, b). Trajectories that meet stay
    together, so the table shrinks; once one value is left the rest of the
    chunk is a scalar loop."""
    starts = np.arange(a, b, dtype=np.int64)
    uniq = starts.copy()                           # distinct current balances
    idx = np.arange(len(starts))                   # start -> position in uniq
    ds = deltas.tolist()
    i = 0
    while i < len(ds):
        if len(uniq) == 1:
            v = int(uniq[0])
            for x in ds[i:]:
                if v + x >= 0:
                    v += x
            uniq = np.array([v], dtype=np.int64)
            break
        x = ds[i]
        i += 1
        if x >= 0:
            uniq = uniq + x
            continue
        ok = uniq + x >= 0
        if ok.all():
            uniq = uniq + x
        elif ok.any():
            uniq, inv = np.unique(np.where(ok, uniq + x, uniq), return_inverse=True)
            idx = inv[idx]
    shift = uniq[idx] - starts
    keep = np.ones(len(shift), dtype=bool)
    keep[1:] = shift[1:] != shift[:-1]
    return starts[keep], shift[keep]


def _transfer_some(deltas: list[int], first: int, a: int, b: int, budget: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The transfer function on starts [a, b) of as many deltas from ``first`` on as
    leave it at most ``budget`` pieces (one delta at least), and where they end. A
    negative delta that every start can pay moves all pieces by one addition."""
    lo, shift, moved, low = np.array([a], dtype=np.int64), np.array([0], dtype=np.int64), 0, a
    for i in range(first, len(deltas)):
        d = deltas[i]
        if d >= 0 or low + moved + d >= 0:     # low: the smallest balance, without what all moved by
            moved += d
            continue
        hi = np.append(lo[1:], b)
        split = -d - moved - shift                 # first start accepted in each piece
        part = (split > lo) & (split < hi)         # pieces cut in two
        new = np.where(split <= lo, shift + d, shift)
        if part.any():
            at = np.flatnonzero(part)
            lo = np.insert(lo, at + 1, split[at])
            new = np.insert(new, at + 1, shift[at] + d)
        keep = np.ones(len(lo), dtype=bool)        # merge neighbours with equal shift
        keep[1:] = new[1:] != new[:-1]
        lo, shift = lo[keep], new[keep]
        low = int((lo + shift).min())
        if len(lo) > budget:
            return lo, shift + moved, i + 1
    return lo, shift + moved, len(deltas)


def _summary(deltas: np.ndarray, a: int, b: int, budget: int = PIECES) -> list[tuple[np.ndarray, np.ndarray]]:
    """A run's transfer function on starts [a, b) as functions of its parts, one after
    another. A part ends where its pieces go over the budget; the next one is
    summarised on the balances that the starts have reached there, which are fewer and
    fewer, until a table holds them. The whole has about as many pieces as deltas,
    however wide the window, and a fold needs a binary search per part."""
    parts, i, values = [], 0, deltas.tolist()
    prefix = np.cumsum(np.append(0, deltas))
    lowest = np.minimum.accumulate(prefix[::-1])[::-1]  # from each delta on
    while i < len(values) or not parts:
        if a + lowest[i] - prefix[i] >= 0:         # every start pays for all that is left
            parts.append((np.array([a], dtype=np.int64), np.array([prefix[-1] - prefix[i]], dtype=np.int64)))
            break
        if b - a <= TABULATE_MAX_WIDTH:
            parts.append(_transfer_table(deltas[i:], a, b))
            break
        lo, shift, i = _transfer_some(values, i, a, b, budget)
        parts.append((lo, shift))
        a, b = int((lo + shift).min()), int((np.append(lo[1:], b) + shift).max())
    return parts


def replay(start: int, deltas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Balances after each delta and acceptance flags, from a known start."""
    prefix = np.cumsum(deltas)
    if len(prefix) == 0 or start + prefix.min() >= 0:
        return start + prefix, np.ones(len(deltas), dtype=bool)
    bal = np.empty(len(deltas), dtype=np.int64)
    ok = np.empty(len(deltas), dtype=bool)
    b = start
    for i, d in enumerate(deltas.tolist()):
        if b + d >= 0:
            b += d
            ok[i] = True
        else:
            ok[i] = False
        bal[i] = b
    return bal, ok


def _run_starts(*cols: np.ndarray) -> np.ndarray:
    """Indexes where a run of equal values (over all columns) begins."""
    n = len(cols[0])
    change = np.ones(n, dtype=bool)
    if n > 1:
        change[1:] = False
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _iter_runs(it, extra: tuple[str, ...] = ()):
    """Complete (key, chunk) runs of rows sorted by key (and chunk), across
    Arrow batches: the last run of a batch may continue in the next one, so
    its rows are held back and prepended. Yields (key, chunk, deltas, extras)."""
    held: list[pd.DataFrame] = []                  # the open run's rows, joined once when it ends
    for pdf in it:
        if pdf.empty:
            continue
        if held:
            last = held[-1]
            same = (pdf["_k0"].to_numpy() == last["_k0"].iat[-1]) & (pdf["_chunk"].to_numpy() == last["_chunk"].iat[-1])
            if same.all():
                held.append(pdf)
                continue
            cut = int(np.argmin(same))
            yield _one_run(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True), extra)
            pdf = pdf.iloc[cut:]
        k0, ch = pdf["_k0"].to_numpy(), pdf["_chunk"].to_numpy()
        bounds = np.append(_run_starts(k0, ch), len(pdf))
        for a, b in zip(bounds[:-2], bounds[1:-1]):
            yield _one_run(pdf.iloc[a:b], extra)
        held = [pdf.iloc[bounds[-2]:]]
    if held:
        yield _one_run(pd.concat(held, ignore_index=True), extra)


def _one_run(run: pd.DataFrame, extra: tuple[str, ...]):
    return run["_k0"].iat[0], int(run["_chunk"].iat[0]), run["_delta"].to_numpy(dtype=np.int64), [run[c].iat[0] for c in extra]


def _batched(rows_iter, columns, size: int = 4096):
    rows = []
    for r in rows_iter:
        rows.append(r)
        if len(rows) >= size:
            yield pd.DataFrame(rows, columns=columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=columns)


def _reflections(it):
    """Phase A, per chunk run: the reflected walk r = max(0, r + d) maps a
    start s to max(s + total, m) with m = total - min(0, min prefix); plus the
    largest negative step. All vectorised."""
    def rows():
        for k, c, d, _ in _iter_runs(it):
            pre = np.cumsum(d)
            total = int(pre[-1])
            yield (k, c, total, total - min(0, int(pre.min())), max(0, -int(d.min())))
    yield from _batched(rows(), ["_k0", "_chunk", "_total", "_m", "_dneg"])


def _bounds_fold(it):
    """Phase B, per product over its chunks in order: the reflected balance
    at each chunk start (exact, from the opening) and the width w of the
    window [r, r + w) that must hold the true balance. The refusal ledger never
    drops below the reflected walk and never exceeds it by the largest
    negative step seen so far (a refusal leaves at most |d| - 1 above it)."""
    last_key, r, w = object(), 0, 0
    for pdf in it:
        keys, chunks = pdf["_k0"].to_numpy(), pdf["_chunk"].to_numpy()
        op, tot = pdf["_opening"].to_numpy(dtype=np.int64), pdf["_total"].to_numpy(dtype=np.int64)
        m, dneg = pdf["_m"].to_numpy(dtype=np.int64), pdf["_dneg"].to_numpy(dtype=np.int64)
        lo = np.empty(len(pdf), dtype=np.int64)
        width = np.empty(len(pdf), dtype=np.int64)
        for i in range(len(pdf)):
            if keys[i] != last_key:
                last_key, r, w = keys[i], int(op[i]), 0
            if chunks[i] == OPENING:
                continue
            lo[i], width[i] = r, max(1, w)
            r = max(r + int(tot[i]), int(m[i]))
            w = max(w, int(dneg[i]))
        of_chunk = chunks != OPENING
        yield pd.DataFrame({"_k0": keys[of_chunk], "_chunk": chunks[of_chunk], "_a": lo[of_chunk], "_w": width[of_chunk]})


def _summaries(it):
    """Phase C, per chunk run: its exact transfer function on its start window."""
    def rows():
        for k, c, d, (a, w) in _iter_runs(it, ("_a", "_w")):
            parts = _summary(d, int(a), int(a) + int(w))
            yield (k, c, [x for lo, _ in parts for x in lo.tolist()], [x for _, sh in parts for x in sh.tolist()], [len(lo) for lo, _ in parts])
    yield from _batched(rows(), ["_k0", "_chunk", "_lo", "_shift", "_pieces"])


def _fold_starts(it):
    """Summaries sorted by (key, chunk): each chunk's opening balance is the
    previous chunk's end, evaluated through that chunk's transfer function.
    One pass per partition; a key's fold may continue into the next batch."""
    last_key, bal = object(), 0
    for pdf in it:
        keys, chunks = pdf["_k0"].to_numpy(), pdf["_chunk"].to_numpy()
        starts = np.empty(len(pdf), dtype=np.int64)
        for i, (lo, sh, pieces) in enumerate(zip(pdf["_lo"], pdf["_shift"], pdf["_pieces"])):
            lo = np.asarray(lo, dtype=np.int64)
            if keys[i] != last_key:
                # the first chunk's window is [opening, opening + 1)
                last_key, bal = keys[i], int(lo[0])
            starts[i] = bal
            at = 0
            for n in pieces:                       # the parts of the chunk, in order
                j = int(np.searchsorted(lo[at:at + n], bal, side="right")) - 1
                if j < 0:
                    raise ValueError(f"ledger: balance {bal} below the start window of chunk {chunks[i]}")
                bal, at = bal + int(sh[at + j]), at + n
        yield pd.DataFrame({"_k0": keys, "_chunk": chunks, "_start": starts})


def _replays(it):
    """Rows sorted by (key, chunk, ts, seq). Every run's balances come from one
    cumulative sum; a run whose opening covers its deficit is done, the others
    are replayed with the loop. A run continuing into the next Arrow batch
    carries its balance over."""
    last, carry = None, 0
    for pdf in it:
        if pdf.empty:
            continue
        k0, ch = pdf["_k0"].to_numpy(), pdf["_chunk"].to_numpy()
        d = pdf["_delta"].to_numpy(dtype=np.int64)
        first = _run_starts(k0, ch)
        run = np.cumsum(np.isin(np.arange(len(d)), first)) - 1
        start = pdf["_start"].to_numpy(dtype=np.int64)[first].copy()
        if last is not None and (k0[0], ch[0]) == last:
            start[0] = carry
        cs = np.cumsum(d)
        prefix = cs - (cs[first] - d[first])[run]
        deficit = np.minimum.reduceat(prefix, first)
        bal = start[run] + prefix
        acc = np.ones(len(d), dtype=bool)
        ends = np.append(first[1:], len(d))
        for r in np.flatnonzero(start + deficit < 0):
            a, b = first[r], ends[r]
            rb, ra = replay(int(start[r]), d[a:b])
            bal[a:b], acc[a:b] = rb, ra
        before = bal - np.where(acc, d, 0)
        last, carry = (k0[-1], ch[-1]), int(bal[-1])
        yield pdf.drop(columns=["_start"]).assign(_before=before, _balance=bal, _accepted=acc)


def _pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder: partitions and their
    order stay, lineage ends, nothing is kept on executors. (The write reads the
    shuffle of the first computation again; nothing before it runs twice.)"""
    return df.checkpoint(eager=True)


def _attach(chunked: DataFrame, table: DataFrame) -> DataFrame:
    """Join a per-chunk table to the chunk rows. Adaptive execution picks the join
    by the table's bytes; the sort restores chunk order after a shuffle and finds
    it in place after a broadcast."""
    return chunked.join(table, ["_k0", "_chunk"]).sortWithinPartitions("_k0", "_chunk", "_ts", "_seq")


def ledger(deltas: DataFrame, opening: DataFrame | None = None, key: str = "product_id",
           ts: str = "ts", seq: str = "event_id", delta: str = "delta",
           default_opening: int = 0, num_chunks: int | None = None) -> DataFrame:
    """Balances of every delta: ``balance_before``, ``balance`` (after),
    ``accepted`` and the refusal ``message`` (null when accepted).

    ``opening`` (key, opening) gives start balances; products missing from it
    start at ``default_opening``.
    """
    spark = deltas.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = deltas.select(F.col(key).alias("_k0"), F.col(ts).alias("_ts"), F.col(seq).alias("_seq"),
                         F.col(delta).cast("bigint").alias("_delta"))
    # phase 1: ordered range partitions; a hot key is split by time
    chunked = _pinned(base.repartitionByRange(n, "_k0", "_ts", "_seq")
                      .sortWithinPartitions("_k0", "_ts", "_seq")
                      .withColumn("_chunk", F.spark_partition_id()))
    ktype = chunked.schema["_k0"].dataType.simpleString()

    # phase A: reflected-walk map of every chunk (vectorised, parallel)
    refl = chunked.select("_k0", "_chunk", "_delta").mapInPandas(
        _reflections, f"_k0 {ktype}, _chunk int, _total bigint, _m bigint, _dneg bigint")
    refl = refl.withColumn("_opening", F.lit(default_opening).cast("bigint"))
    if opening is not None:
        # a row before the chunks, not a join: after a join on the key Spark leaves the
        # exchange below out, and once adaptive execution broadcasts the openings and
        # reads the chunks locally, a product's chunks lie in several partitions
        none = [F.lit(0).cast("bigint").alias(c) for c in ("_total", "_m", "_dneg")]
        refl = refl.unionByName(opening.where(F.col(key).isNotNull()).select(
            F.col(key).cast(ktype).alias("_k0"), F.lit(OPENING).alias("_chunk"), *none,
            F.coalesce(F.col("opening").cast("bigint"), F.lit(default_opening).cast("bigint")).alias("_opening")))
    # phase B: start window of every chunk (a fold over <= one row per
    # partition the product touches); cached: derived from the checkpoint
    windows = _pinned(refl.repartition("_k0").sortWithinPartitions("_k0", "_chunk")
                     .mapInPandas(_bounds_fold, f"_k0 {ktype}, _chunk int, _a bigint, _w bigint"))
    # phase C: exact transfer function of every chunk on its window (parallel)
    summaries = _attach(chunked, windows).select("_k0", "_chunk", "_delta", "_a", "_w").mapInPandas(
        _summaries, f"_k0 {ktype}, _chunk int, _lo array<bigint>, _shift array<bigint>, _pieces array<int>")
    # phase D: exact opening balance of every chunk
    starts = _pinned(summaries.repartition("_k0").sortWithinPartitions("_k0", "_chunk")
                    .mapInPandas(_fold_starts, f"_k0 {ktype}, _chunk int, _start bigint"))
    # phase E: replay every chunk from its opening balance (parallel)
    tagged = _attach(chunked, starts)
    tagged = tagged.select("_k0", "_chunk", "_ts", "_seq", "_delta", "_start")
    schema = (f"_k0 {ktype}, _chunk int, _ts {chunked.schema['_ts'].dataType.simpleString()}, "
              f"_seq {chunked.schema['_seq'].dataType.simpleString()}, _delta bigint, "
              "_before bigint, _balance bigint, _accepted boolean")
    out = tagged.mapInPandas(_replays, schema)
    msg = F.when(~F.col("_accepted"),
                 F.format_string(C.MSG_STOCK_BELOW_ZERO, F.col("_before"), F.col("_delta")))
    return out.select(F.col("_k0").alias(key), F.col("_ts").alias(ts), F.col("_seq").alias(seq),
                      F.col("_delta").alias(delta), F.col("_before").alias("balance_before"),
                      F.col("_balance").alias("balance"), F.col("_accepted").alias("accepted"),
                      msg.alias("message"))


def final_balances(ledger_rows: DataFrame, key: str = "product_id", ts: str = "ts",
                   seq: str = "event_id") -> DataFrame:
    """Last balance per product (partial aggregation: safe for hot products)."""
    return ledger_rows.groupBy(key).agg(
        F.max_by("balance", F.struct(ts, seq)).alias("balance"),
        F.count(F.lit(1)).alias("n_deltas"),
        F.count(F.when(~F.col("accepted"), 1)).alias("n_refused"))
