"""Lifecycle replays (orders, forecast jobs) and versioned writes.

A run of events maps the state before it to the state after it: a finite
function, and the functions of two runs compose. So a replay is split like this,
a key that holds a third of all events included:

1. Events are range-partitioned by (key, time, sequence, action) and sorted; the
   partitions (chunks) are checkpointed, so their bounds stay.
2. A key can only go over the edge of a chunk as its first or last key. Each chunk
   gives the functions of those two runs, two rows at most (``_edge_maps``).
3. A fold over these rows, per key and in chunk order, gives the state in which
   every chunk's first key arrives: a row per chunk.
4. Each chunk is replayed from there (``_verdicts``), batch by batch, all keys of a
   batch together; a run's state goes on into the next batch.

The events are shuffled once. Final states are a partially aggregated group-by over
the verdicts. Any machine will do, also one that returns to a state.

Defined order: events at one (time, sequence) follow in the order of their action's
text, each judged by what the one before left, so an event that is delivered twice
is accepted once. An unknown or null action is refused without a text. Nulls in time
or sequence come first; a null key is a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Machine:
    start: str
    # state -> {action: next state}
    moves: dict
    # (action, state) -> refusal text column builder
    refusal: callable


def _order_refusal(action: Column, state: Column) -> Column:
    return (F.when(action == "CONFIRM", F.concat(F.lit(C.MSG_CONFIRM), state))
            .when(action == "SHIP", F.concat(F.lit(C.MSG_SHIP), state))
            .when(action == "DELIVER", F.concat(F.lit(C.MSG_DELIVER), state))
            .when((action == "CANCEL") & (state == "CANCELLED"), F.lit(C.MSG_CANCEL_TWICE))
            .when(action == "CANCEL", F.concat(F.lit(C.MSG_CANCEL_LATE), state)))


def _job_refusal(action: Column, state: Column) -> Column:
    return (F.when(action == "START", F.concat(F.lit(C.MSG_JOB_START), state))
            .when(action == "COMPLETE", F.concat(F.lit(C.MSG_JOB_COMPLETE), state))
            .when(action == "FAIL", F.concat(F.lit(C.MSG_JOB_FAIL), state)))


# --- fixed values: the two machines -----------------------------------------
ORDER_MACHINE = Machine(
    start="PENDING",
    moves={
        "PENDING": {"CONFIRM": "CONFIRMED", "CANCEL": "CANCELLED"},
        "CONFIRMED": {"SHIP": "SHIPPED", "CANCEL": "CANCELLED"},
        "SHIPPED": {"DELIVER": "DELIVERED"},
    },
    refusal=_order_refusal,
)

JOB_MACHINE = Machine(
    start="PENDING",
    moves={
        "PENDING": {"START": "RUNNING"},
        "RUNNING": {"COMPLETE": "COMPLETED", "FAIL": "FAILED"},
    },
    refusal=_job_refusal,
)


class _Table:
    """A machine as arrays: the state after each (state, action), and what a run of
    actions does to several keys at once."""

    def __init__(self, machine: Machine):
        self.states = list(dict.fromkeys([machine.start, *machine.moves, *(t for m in machine.moves.values() for t in m.values())]))
        self.actions = list(dict.fromkeys(a for m in machine.moves.values() for a in m))
        number = {s: k for k, s in enumerate(self.states)}
        # a last column for unknown actions, which change nothing
        self.after = np.tile(np.arange(len(self.states))[:, None], (1, len(self.actions) + 1))
        self.moves = np.zeros(self.after.shape, bool)
        for s, m in machine.moves.items():
            for a, t in m.items():
                self.after[number[s], self.actions.index(a)] = number[t]
                self.moves[number[s], self.actions.index(a)] = True

    def code(self, action: Column) -> Column:
        """An action's column in the table."""
        known = F.create_map(*[x for k, a in enumerate(self.actions) for x in (F.lit(a), F.lit(k))])
        return F.coalesce(F.try_element_at(known, F.coalesce(action, F.lit(""))), F.lit(len(self.actions))).cast("int")

    def name(self, state: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, self.states)), state + 1)

    def _soonest(self, codes: np.ndarray) -> np.ndarray:
        """Per state and position the next event that the state accepts."""
        n, at = len(codes), np.arange(len(codes))
        out = np.full((len(self.states), n + 1), n)
        for s in range(len(self.states)):
            out[s, :n] = np.minimum.accumulate(np.where(self.moves[s, codes], at, n)[::-1])[::-1]
        return out

    def function(self, codes: np.ndarray) -> np.ndarray:
        """The state after the actions for each state before them."""
        soonest, now, here = self._soonest(codes), np.arange(len(self.states)), np.zeros(len(self.states), np.int64)
        going = now.copy()
        while len(going):
            j = soonest[now[going], here[going]]
            going, j = going[j < len(codes)], j[j < len(codes)]
            now[going], here[going] = self.after[now[going], codes[j]], j + 1
        return now

    def run(self, codes: np.ndarray, start: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs that begin at ``start`` (ascending, the first at 0) in the given
        states: the state before each event, whether it is accepted, and the runs'
        last states. Takes one step per accepted event of the run with most."""
        n, at = len(codes), np.arange(len(codes))
        end, soonest = np.append(start[1:], n), self._soonest(codes)
        new, here, now = np.full(n, -1), start.copy(), state.copy()
        going = np.arange(len(start))
        while len(going):
            j = soonest[now[going], here[going]]
            hit = j < end[going]
            going, j = going[hit], j[hit]
            new[j] = now[going] = self.after[now[going], codes[j]]
            here[going] = j + 1
        accepted = new >= 0
        # the state before an event: that of the last accepted one of its run, or the run's own
        owner = np.repeat(np.arange(len(start)), end - start)
        last = np.append(-1, np.maximum.accumulate(np.where(accepted, at, -1))[:-1])
        return np.where(last >= start[owner], new[last], state[owner]), accepted, now


def _runs(keys: pa.Array) -> np.ndarray:
    """Where runs of one key begin."""
    code = np.asarray(keys.dictionary_encode().indices.fill_null(-1))
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))


def _edge_maps(machine: Machine):
    """Per chunk the functions of its first and its last run (one row if they are
    the same): key, chunk and ``_map``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, open_, first = _Table(machine), None, True  # open_: key and function of the run that may go on

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([open_[0], pa.array([chunk], pa.int32()), pa.array([open_[1].tolist()], pa.list_(pa.int32()))],
                                              names=["_k0", "_chunk", "_map"])

        for b in batches:
            if not b.num_rows:
                continue
            keys, chunk, codes = b.column(0), b.column(1)[0].as_py(), b.column(2).to_numpy()
            start = _runs(keys)
            head = t.function(codes[:start[1] if len(start) > 1 else len(codes)])
            if open_ is not None and keys.slice(0, 1).equals(open_[0]):
                open_ = (open_[0], head[open_[1]])
            else:
                if open_ is not None and first:
                    yield row()
                    first = False
                open_ = (keys.slice(0, 1), head)
            if len(start) > 1:
                if first:
                    yield row()
                    first = False
                open_ = (keys.slice(start[-1], 1), t.function(codes[start[-1]:]))
        if open_ is not None:
            yield row()
    return run


def _arrivals(machine: Machine):
    """Rows of ``_edge_maps`` in (key, chunk) order: the state in which each run
    begins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, key, state = _Table(machine), None, 0
        start = t.states.index(machine.start)
        for b in batches:
            states = []
            for i, m in enumerate(b.column(2).to_pylist()):
                if key is None or not b.column(0).slice(i, 1).equals(key):
                    key, state = b.column(0).slice(i, 1), start
                states.append(state)
                state = m[state]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(states, pa.int32())], names=["_chunk", "_arrival"])
    return run


def _verdicts(machine: Machine):
    """Chunk rows in order, with ``_arrival`` (null where a chunk's first key is
    new): the rows with their number, the state before and after, and whether they
    are accepted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, key, state, n = _Table(machine), None, 0, 0
        begin = t.states.index(machine.start)
        for b in batches:
            if not b.num_rows:
                continue
            keys, codes = b.column("_k0"), b.column("_code").to_numpy()
            start = _runs(keys)
            states = np.full(len(start), begin)
            if key is None:
                arrival = b.column("_arrival")[0].as_py()
                states[0] = begin if arrival is None else arrival
                n = b.column("_chunk")[0].as_py() << 36
            elif keys.slice(0, 1).equals(key):
                states[0] = state
            before, accepted, now = t.run(codes, start, states)
            key, state = keys.slice(b.num_rows - 1, 1), now[-1]
            cols = [b.column(c) for c in ("_k0", "_ts", "_seq", "_action")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.arange(n, n + b.num_rows)), pa.array(before, pa.int32()), pa.array(t.after[before, codes], pa.int32()),
                 pa.array(accepted)], names=["_k0", "_ts", "_seq", "_action", "_no", "_before", "_after", "_accepted"])
            n += b.num_rows
    return run


def replay(events: DataFrame, machine: Machine, key: str = "order_id", ts: str = "ts",
           seq: str = "event_id", action: str = "action", num_chunks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(final, verdicts)``.

    final: key, status, n_events, n_accepted, n_refused, last_change (ts of the
    last accepted event). verdicts: every event with status_before,
    status_after, accepted and the refusal message.
    """
    spark, t = events.sparkSession, _Table(machine)
    ensure_checkpoint_dir(spark)
    n = num_chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = ["_k0", "_ts", "_seq", "_action"]
    chunked = (events.select(F.col(key).alias("_k0"), F.col(ts).alias("_ts"), F.col(seq).alias("_seq"), F.col(action).alias("_action"),
                             t.code(F.col(action)).alias("_code"))
               .repartitionByRange(n, *place).sortWithinPartitions(*place).withColumn("_chunk", F.spark_partition_id())
               .checkpoint(eager=True))
    kind = {f.name: f.dataType.simpleString() for f in chunked.schema.fields}
    edges = chunked.select("_k0", "_chunk", "_code").mapInArrow(_edge_maps(machine), f"_k0 {kind['_k0']}, _chunk int, _map array<int>")
    # two rows per chunk at most; of a chunk's two runs only the first one can arrive from another chunk
    arrivals = (edges.repartition("_k0").sortWithinPartitions("_k0", "_chunk")
                .mapInArrow(_arrivals(machine), "_chunk int, _arrival int"))
    start = t.states.index(machine.start)
    arrivals = arrivals.where(F.col("_arrival") != start).groupBy("_chunk").agg(F.max("_arrival").alias("_arrival"))
    judged = (chunked.join(F.broadcast(arrivals), "_chunk", "left")  # at most a row per chunk
              .select(*place, "_chunk", "_code", "_arrival")
              .mapInArrow(_verdicts(machine), ", ".join([*(f"{c} {kind[c]}" for c in place), "_no long, _before int, _after int, _accepted boolean"])))
    verdicts = judged.select(
        F.col("_k0").alias(key), F.col("_ts").alias(ts), F.col("_seq").alias(seq), F.col("_action").alias(action),
        t.name(F.col("_before")).alias("status_before"), F.col("_accepted").alias("accepted"), t.name(F.col("_after")).alias("status_after"))
    verdicts = verdicts.withColumn("message", F.when(~F.col("accepted"), machine.refusal(F.col(action), F.col("status_before"))))
    final = judged.groupBy("_k0").agg(
        F.max_by("_after", "_no").alias("_last"), F.count(F.lit(1)).alias("n_events"),
        F.count_if("_accepted").alias("n_accepted"), F.max(F.when(F.col("_accepted"), F.col("_ts"))).alias("last_change"))
    final = final.select(F.col("_k0").alias(key), t.name(F.col("_last")).alias("status"), "n_events", "n_accepted",
                         (F.col("n_events") - F.col("n_accepted")).alias("n_refused"), "last_change")
    return final, verdicts


def order_lifecycle(events: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    return replay(events, ORDER_MACHINE, **kw)


def job_lifecycle(events: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    return replay(events, JOB_MACHINE, **{"key": "job_id", **kw})


def versioned_update(table: DataFrame, updates: DataFrame, key: str = "id",
                     version: str = "version", ts: str = "ts", update_id: str = "update_id") -> DataFrame:
    """Optimistic concurrency: an update names the version it read. Among the
    updates of one row that read the current version, the first by (ts,
    update_id) wins and bumps the version; every other one is stale.
    Unknown ids are reported as such."""
    cur = table.select(F.col(key).alias("_k"), F.col(version).alias("_cur"))
    u = updates.select("*", F.col(key).alias("_k"))
    j = u.join(cur, "_k", "left")
    winner = (j.where(F.col(version) == F.col("_cur"))
              .groupBy("_k").agg(F.min(F.struct(F.col(ts), F.col(update_id))).alias("_w")))
    out = j.join(winner, "_k", "left")
    won = F.col("_w").isNotNull() & (F.struct(F.col(ts), F.col(update_id)) == F.col("_w"))
    return out.select(
        F.col("_k").alias(key), F.col(update_id), F.col(ts), F.col(version).alias("read_version"),
        F.when(F.col("_cur").isNull(), "UNKNOWN_ID").when(won, "ACCEPTED").otherwise("STALE").alias("outcome"),
        F.when(won, F.col("_cur") + 1).alias("new_version"))
