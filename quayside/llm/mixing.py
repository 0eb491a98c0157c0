"""Mixing sources to target weights by subset-sum budget fitting.

``targets`` shares a budget over sources by weight, a source getting at most
``most`` times its size and the excess going to the others. A source whose
target is e times its size and a rest takes every document e times; the rest is
the budget of a subset sum over the source's histogram of document sizes:

1. every size gives the same share of its documents, largest size first, its
   fraction of a document carried to the next size from a seeded start; the
   share of the sizes to come is that of the budget still open, so what one size
   took too much or too little is spread over all smaller documents. A reserve stays open: ``RESERVE``
   documents of mean size, at most half of ``window`` (of up to twice ``RESERVE``
   documents, all that step 3 can fill);
2. only where no smaller documents are left to make up for large ones, more
   documents are taken, largest size first, while more than four times
   ``window`` is missing;
3. a bounded-knapsack dynamic program finds the reachable sum nearest to the last
   budget, over a seeded sample of the documents left and, only if that does not
   meet it, over all of them, by size.

Only histograms enter the plan, never documents. Documents of a size are then
taken by seeded rank within (source, size), see ``rank_within``.

Defined cases. Null and empty texts have size 0 and take part with 0 words. A
null source is a source of its own, last in order. Every row is planned by
itself, whatever its id: rows are ranked by id and text, so null ids and ids on
several rows spread like any others, and a row key tells rows apart. Rows equal
in both may differ in what they take, but reruns give the same rows. ``mix``
reads id, text and source only, so other names cannot clash. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import WORD, rank_within, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_SOURCES = 200_000  # a mix is set per source; their names and sizes fit the driver
WINDOW = 1 << 14
RESERVE = 32


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], budget: float, most: float = 2.0) -> list[float]:
    """The budget by weight, each share at most ``most`` times the size."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), budget
    while open_:
        per = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if per * weights[k] > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = per * weights[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        open_ = [k for k in open_ if k not in set(full)]
    return out


def _candidates(sizes: np.ndarray, free: np.ndarray, n: float, rng: np.random.Generator) -> Iterator[tuple[int, int]]:
    """Sizes and numbers of free documents for the program: about ``n`` documents
    of a random sample, by size in random order, then all others, smallest first."""
    left = int(free.sum())
    ends, n = np.cumsum(free), min(left, int(n) + 16)
    some = np.zeros(len(free), np.int64)
    if n:  # places of documents, without repeats where they are few
        at = rng.permutation(left)[:n] if left <= 4 * n else np.unique(rng.integers(0, left, n))
        np.add.at(some, np.searchsorted(ends, at, side="right"), 1)
    for k in rng.permutation(np.flatnonzero(some)):
        yield int(k), int(some[k])
    for k in np.flatnonzero(free - some):
        yield int(k), int(free[k] - some[k])


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW, seed: int | tuple[int, ...] = 0) -> np.ndarray:
    """How many documents of each distinct size (ascending, positive) to take so
    that their sum comes as near to ``budget`` as the program finds."""
    if not len(sizes):
        return counts.copy()
    window = max(window, min(2 * int(sizes[-1]), (1 << 25) // len(sizes)))  # bits of the program's rows
    total = int((sizes * counts).sum())
    budget = min(max(budget, 0), total)
    if budget == total:
        return counts.copy()
    rng = np.random.default_rng(seed)
    take, due = np.zeros(len(sizes), np.int64), rng.random()
    mean = total / int(counts.sum())
    reserve = min(4 * window if counts.sum() <= 2 * RESERVE else int(min(RESERVE * mean, window // 2)), budget)
    open_, rest, spare = budget - reserve, total, 0
    for k in range(len(sizes) - 1, -1, -1) if reserve < budget else ():
        size, n = int(sizes[k]), int(counts[k])
        due += n * (open_ / rest)
        rest -= n * size
        fits = n * size if 4 * size <= reserve else 0
        # as many as all others that are left could not make up for
        least = min(n, -(-max(open_ + reserve - rest - spare - fits, 0) // size), (open_ + reserve) // size)
        take[k] = max(least, min(n, max(int(due), 0), open_ // size))
        due -= int(take[k])
        open_ -= int(take[k]) * size
        spare += (n - int(take[k])) * size if 4 * size <= reserve else 0
    missing = budget - int((take * sizes).sum())
    for k in range(len(sizes) - 1, -1, -1):
        if missing <= 4 * window:
            break
        more = int(min(counts[k] - take[k], (missing - 4 * window + sizes[k] - 1) // sizes[k], missing // sizes[k]))
        take[k] += more
        missing -= more * int(sizes[k])
    # Bits of `reach` are the sums made so far; counts split into powers of two.
    limit = min(missing, 4 * window) + window
    reach, steps, mask = 1, [], (1 << (limit + 1)) - 1
    for k, free in _candidates(sizes, counts - take, 3 * missing / mean, rng):
        size = int(sizes[k])
        free, lot = min(free, limit // size), 1
        while free > 0:
            lot = min(lot, free)
            grown = (reach | reach << (lot * size)) & mask
            if grown != reach:
                steps.append((k, lot, reach))
                reach = grown
            free -= lot
            lot *= 2
        if reach >> missing & 1:
            break
    best = next((s for d in range(limit + 1) for s in (missing - d, missing + d) if 0 <= s <= limit and reach >> s & 1), 0)
    for k, lot, before in reversed(steps):
        if not before >> best & 1:
            take[k] += lot
            best -= lot * int(sizes[k])
    return take


def _planned(docs: DataFrame, row: Column, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
             seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             size: Column | None = None) -> DataFrame:
    """The rows of ``mix`` with their key ``row`` as ``__row``."""
    source = F.when(F.col(source_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    order = F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text"), row.alias("row"))
    rows = written(docs.select(order.alias("__order"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("__spread"),
                               source.alias("__source"),
                               (n_words(F.col(text_col)) if size is None else size).alias("size")), "mix-sizes")
    histogram = written(rows.groupBy("__source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    sources = histogram.groupBy("__source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix by a coarser column")
    sources = sorted(((r[0], int(r[1])) for r in sources))
    sizes = [s for _, s in sources]
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share * sum(sizes), most)
    plan = {name: (s, t, int(t // s) if s else 0) for (name, s), t in zip(sources, goal)}
    table = docs.sparkSession.createDataFrame(
        [(name, s, float(t), e, round(t - e * s)) for name, (s, t, e) in plan.items()],
        "__source string, source_size long, target double, epochs long, budget long")

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["size"] > 0].sort_values("size", ignore_index=True)
        take = fit(pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), int(pdf["budget"].iloc[0]),
                   seed=(seed & 0xFFFFFFFF, zlib.crc32(pdf["__source"].iloc[0].encode()))) if len(pdf) else []
        return pdf[["__source", "size"]].assign(extra=take)

    extra = written(histogram.join(table, "__source").select("__source", "size", "n", "budget")
                    .groupBy("__source").applyInPandas(chosen, "__source string, size long, extra long"), "mix-plan")
    ranked = rank_within(rows, ["__source", "size"], "__spread", "__rank", seed, ties="__order")
    out = (ranked.join(extra.where("extra > 0"), ["__source", "size"], "left").join(table, "__source"))
    copies = F.col("epochs") + F.coalesce(F.col("__rank") < F.col("extra"), F.lit(False)).cast("long")
    return out.select(F.col("__order.row").alias("__row"), F.col("__order.id").alias(id_col), "size", "source_size", "target",
                      copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """One row per input row: id, ``size``, ``source_size`` and ``target`` of its
    source, ``copies`` (how often the mix holds it) and ``taken`` (its words in
    the mix). Sources in code point order, null last, get ``weights`` in turn and
    share ``share`` times all words. For keywords see ``_planned``."""
    return _planned(docs, F.monotonically_increasing_id(), **kw).drop("__row")


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: every document as often as it was taken, with all its
    columns. Documents of size 0 hold no words and go. The rows are written with
    a key of their own before planning, and the plan comes back by that key, so
    ids may be null or stand on several rows."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    how = _planned(rows, F.col("__row"), **kw).where("taken > 0").select("__row", F.col("copies").alias("__copies"))
    return (rows.join(how, "__row")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
            .select(*docs.columns))
