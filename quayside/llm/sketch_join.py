"""Parity-sketch join: documents whose word-shingle sets are similar.

Two documents link when ``100 * |A and B| >= percent * |A or B|`` for their sets
of distinct ``size``-word shingles (``sketches.shingle_set``).

1. One pass over the texts gives, per document, the set's size, a 128-bit digest
   and a 512-bit parity sketch, and counts the keys of all sketch parts in a
   fixed table of 2**20 cells (4 MB, whatever the input; summed slice by slice).
2. The shingles of a set flip bits in the parts of a wide parity sketch, one
   sketch per size band. Linked sets differ in at most d parts, so of any order
   that depends on a part's content alone they share one of their first d + 1
   parts. The order is by rarity (the counts of step 1): text that thousands of
   documents share comes last and mostly drops out.
3. Part keys met by more than one distinct set make candidates. Copies fold into one
   representative: among the documents that a task reads together before anything is
   shuffled, then where a key's rows meet. That is the only shuffle of all keys; a
   key's rows go by in order and only keys with two sets or more are written.
4. Per live key, each member is paired with one hub, the member with most live
   keys. Pairs must pass the size ratio and the Hamming bound of the 512-bit
   sketches, then the exact intersection of the two shingle sets. Components of
   these links settle most groups with one pair per member.
5. All other pairs of a live key, those between different components, are then
   tried the same way, inside the join, so no link is lost and none is tried
   within a component that already holds together.

No candidate is capped and nothing about all documents reaches the driver.
Shingles are compared by 64-bit hashes.

Defined cases. Null, empty and white-space texts have an empty set and link with
nothing, their component is their own id. Texts with fewer than ``size`` words
have one shingle, the whole sequence. Rows with a null id get their set's size
and a null component and take no part in links. Ids are meant to be unique;
repeated rows get a result row each, and texts under one id are one node. Texts
are read whole. Empty tables give empty results. Only the id and text columns
are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import done_with, written
from quayside.llm.components import components
from quayside.llm.sketches import Bands, dense_sketch, part_keys, rarest, shingle_sets, sketches_apart, wide_sketch

CELLS = 1 << 20  # counts of part keys; the memory of the broadcast is 4 bytes each
SLICES = 64
BROADCAST_IDS = 1_000_000  # 8 MB of ids; beyond, the texts wanted are found by a shuffled join
WORDS = [f"s{i}" for i in range(8)]  # the 512-bit sketch


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Few documents at a time, so a task holds the sets of these only."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def describe(texts: DataFrame, size: int, bands: Bands) -> DataFrame:
    """Per document doc_id, n, f1, f2 (digest), s0..s7 (sketch); and rows with
    ``slice`` and ``cells``, the counts of part keys."""
    fields = [pa.int64(), pa.int32(), *[pa.int64()] * 10]
    names = ["doc_id", "n", "f1", "f2", *WORDS, "slice", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for b in sliced(batches):
            n, marks, keys = [], [], [np.empty(0, np.uint64)]
            for s in shingle_sets(b.column(1).to_pylist(), size):
                n.append(len(s))
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                marks.append(np.concatenate([digest, dense_sketch(s).view(np.int64)]))
                keys += [part_keys(s, band, parts) for band, parts in bands.of(len(s))]
            cells += np.bincount((np.concatenate(keys) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            marks = np.array(marks, np.int64).reshape(len(n), 10)
            cols = [b.column(0), pa.array(n, pa.int32()), *(pa.array(marks[:, k]) for k in range(10))]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=names)
        none = [pa.nulls(SLICES, t) for t in fields]
        yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()),
                                          pa.array([x.tobytes() for x in np.split(cells, SLICES)], pa.binary())], names=names)

    schema = ", ".join(["doc_id long", "n int", *(f"{x} long" for x in names[2:12]), "slice int", "cells binary"])
    return texts.mapInArrow(run, schema)


def _cell_counts(described: DataFrame) -> np.ndarray:
    """The sums of all tasks' cells: 64 slices, each added up in a stream."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(x, np.uint32)
                total[k] = total[k] + x if k in total else x.astype(np.uint64)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(total.keys(), pa.int32()),
                                          "cells": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    rows = (described.where("slice IS NOT NULL").select("slice", "cells").repartition(SLICES, "slice")
            .mapInArrow(add, "slice int, cells binary").collect())  # 64 rows of fixed size
    out = np.zeros(CELLS, np.uint64)
    for k, x in rows:
        out[k * (CELLS // SLICES):(k + 1) * (CELLS // SLICES)] = np.frombuffer(x, np.uint64)
    return np.minimum(out, np.uint64(0xFFFFFFFF)).astype(np.uint32)


def sketch_keys(texts: DataFrame, size: int, bands: Bands, counts) -> DataFrame:
    """(key, doc_id, f1): the rarest d + 1 part keys of each document; of equal sets
    among the documents read together, only under the smallest id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = counts.value
        for b in sliced(batches):
            classes: dict[int, tuple[int, np.ndarray]] = {}
            for doc, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), size)):
                f1 = int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0])
                classes[f1] = (min(doc, classes[f1][0]) if f1 in classes else doc, s)
            keys, n = [np.empty(0, np.uint64)], []
            for _, s in classes.values():
                own = [rarest(part_keys(s, band, parts), cells, bands.differ(len(s)) + 1) for band, parts in bands.of(len(s))]
                keys += own
                n.append(sum(map(len, own)))
            yield pa.RecordBatch.from_pydict({
                "key": np.concatenate(keys).view(np.int64), "doc_id": np.repeat(np.array([d for d, _ in classes.values()], np.int64), n),
                "f1": np.repeat(np.array(list(classes), np.int64), n)})

    return texts.where("doc_id IS NOT NULL").mapInArrow(run, "key long, doc_id long, f1 long")


def meeting(keyed: DataFrame) -> DataFrame:
    """(key, rep) of the keys that two distinct sets or more hold, a row per set with
    its smallest id. One shuffle by key; a partition's rows go by in (key, f1) order,
    with one (key, f1) held back, so nothing grows with a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, had = np.empty((3, 0), np.int64), False  # the last (key, f1, id) and whether its key had a set before it

        def rows(keys: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(reps)], names=["key", "rep"])

        for b in batches:
            if not b.num_rows:
                continue
            key, f1, doc = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, b.columns))
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (f1[1:] != f1[:-1])]))
            key, f1, doc = key[start], f1[start], np.minimum.reduceat(doc, start)
            same = key[1:] == key[:-1]
            met = np.concatenate([[had], same]) | np.concatenate([same, [False]])
            yield rows(key[:-1][met[:-1]], doc[:-1][met[:-1]])
            held, had = np.array([key[-1:], f1[-1:], doc[-1:]]), bool(met[-1])
        if had:
            yield rows(held[0], held[2])

    return (keyed.select("key", "f1", "doc_id").repartition("key").sortWithinPartitions("key", "f1")
            .mapInArrow(run, "key long, rep long"))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Size ratio and Hamming bound: necessary for a link, cheap to test."""
    col = lambda side, x: F.col(f"{side}.{x}")
    na, nb = col(a, "n"), col(b, "n")
    apart = sum((F.bit_count(col(a, w).bitwiseXOR(col(b, w))) for w in WORDS[1:]),
                F.bit_count(col(a, WORDS[0]).bitwiseXOR(col(b, WORDS[0]))))
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb))
            & ((100 + percent) * apart <= (100 - percent) * (na + nb)))


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, exactly."""
    ids = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    few = ids.count() <= BROADCAST_IDS

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            sets = shingle_sets(b.column(1).to_pylist(), size)
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([wide_sketch(x) for x in sets], pa.binary()),
                pa.array([x.tobytes() for x in sets], pa.large_binary()).cast(pa.binary())], names=["doc_id", "n", "wide", "elements"])

    sets = written(texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
                   .mapInArrow(to_sets, "doc_id long, n long, wide binary, elements binary"), "sets")

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("doc_id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, x, nb, y = (c.to_pylist() for c in b.columns[2:])
            good = [(100 + percent) * sketches_apart(p, q) <= (100 - percent) * (m + n) for m, p, n, q in zip(na, x, nb, y)]
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    # wide sketches first: most pairs of large sets that do not link go before the sets travel
    some = written(pairs.join(side("a", "n", "wide"), "a").join(side("b", "n", "wide"), "b")
                   .select("a", "b", "a_n", "a_wide", "b_n", "b_wide").mapInArrow(hopeful, "a long, b long").distinct(), "hopeful")
    out = written(some.join(side("a", "elements"), "a").join(side("b", "elements"), "b")
                  .select("a", "b", "a_elements", "b_elements").mapInArrow(linked, "a long, b long").distinct(), "linked")
    done_with(ids, sets, some)
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: id, ``n_shingles`` and ``component_id``, the
    smallest id reachable by links."""
    spark, bands, texts = docs.sparkSession, Bands(percent), _texts(docs, id_col, text_col)
    described = written(describe(texts, size, bands), "described")
    sets = described.where("slice IS NULL").drop("slice", "cells")
    counts = spark.sparkContext.broadcast(_cell_counts(described))

    members = written(meeting(sketch_keys(texts, size, bands, counts)), "members")

    scores = written(members.groupBy("rep").agg(F.count(F.lit(1)).alias("score")), "scores")
    hubs = written(members.join(scores, "rep").groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("neg"))).alias("h"))
                   .select("key", (-F.col("h.neg")).alias("hub")), "hubs")
    star = members.join(hubs, "key").where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    star = written(star, "star")
    nodes = written(sets.join(scores.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n", *WORDS), "nodes")
    near = (star.join(nodes.alias("k"), F.col("a") == F.col("k.rep")).join(nodes.alias("h"), F.col("b") == F.col("h.rep"))
            .where(_may_link("k", "h", percent)).select("a", "b").distinct())
    near = written(near, "near")
    done_with(hubs, scores)
    first = verified(near, texts, size, percent)
    groups = components(first)
    done_with(near, first)

    placed = written(members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed")
    mixed = written(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                    .where("lo <> hi").select("key"), "mixed")
    rest = written(placed.join(mixed, "key", "left_semi").join(nodes, "rep"), "mixed-members")
    across = (rest.alias("k").join(rest.alias("h"), (F.col("k.key") == F.col("h.key")) & (F.col("k.component") < F.col("h.component")) & _may_link("k", "h", percent))
              .select(F.least("k.rep", "h.rep").alias("a"), F.greatest("k.rep", "h.rep").alias("b")).distinct())
    across = written(across.join(star, ["a", "b"], "left_anti"), "across")
    done_with(placed, mixed, members, rest, star, nodes)
    second = verified(across, texts, size, percent)
    settled = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    groups = written(components(settled.unionByName(second)), "components")

    copies = written(sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2")
                     .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "copies")
    rows = (sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("f1")).alias("f1"), "f2").join(copies, ["f1", "f2"], "left")
            .select("doc_id", "n", F.coalesce("rep", "doc_id").alias("node")).join(groups, "node", "left"))
    return rows.select(F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
                       F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The document with the smallest id of every group, with all its columns;
    rows with a null id stay."""
    gone = (similar_groups(docs, id_col, text_col, size, percent).where(F.col("component_id") != F.col(id_col))
            .select(F.col(id_col).alias("__gone")))
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
