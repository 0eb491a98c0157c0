"""Best-fit packing by planning over the histogram of lengths.

``cut_pieces`` encodes whole documents and cuts those longer than the capacity.
``plan`` packs counts, not documents: lengths go by falling size, every group of
equal sequences is one entry with a count, and pieces of a length go to the
fullest sequences they fit (best fit), whole groups at a time. The histogram has
at most ``capacity`` lengths and the plan's size depends on those alone, so both
stay small whatever the number of documents. The plan is a list of runs: the
pieces of one length with ranks lo..hi-1 lie at one offset of consecutive
sequences. ``pack`` ranks the pieces of each length (``rank_within``, no window
over a whole length) and looks their run up by binary search.

Defined cases. Null and empty texts have the end id alone. Repeated rows and
null ids are packed like others. Long texts are encoded whole and cut into
pieces of exactly the capacity, the last as long as it comes. An empty table
gives an empty result. Only the id and text columns are read, so other names
cannot clash.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import rank_within, written
from quayside.llm.tokens import Encoder, encoder, vocabulary


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, spaces: bool = False,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length and ids (little-endian
    unsigned 32-bit)."""
    file_text = vocabulary(docs.sparkSession, tokenizer)
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(Encoder, file_text.value, spaces, "<u4", True)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, out = b.slice(at, 256), []
                for doc, ids in zip(part.column(0).to_pylist(), own.ids_of(part.column(1).to_pylist())):
                    ids += end
                    out += [(doc, k, k * capacity, (len(x := ids[s:s + width])) // 4, x) for k, s in enumerate(range(0, len(ids), width))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["doc_id", "piece", "start", "length", "ids"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary"))


def plan(counts: dict[int, int], capacity: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank_lo, rank_hi, first sequence, offset): the piece of rank
    r lies in sequence ``first + r - rank_lo`` at ``offset``."""
    # A group: sequences filled alike, as (number, list of [length, number of pieces each]).
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []  # the remaining rooms that have groups, ascending

    def add(room: int, n: int, filled: list[tuple[int, int]]) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([n, filled])

    for length in sorted((x for x, c in counts.items() if c > 0), reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length  # new sequences, each filled with this length
                if left >= each:
                    add(capacity - each * length, left // each, [(length, each)])
                if left % each:
                    add(capacity - left % each * length, 1, [(length, left % each)])
                break
            room = rooms[k]
            n, filled = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(k)
            each = min(room // length, left)
            full = min(n, left // each)
            if n > full:
                add(room, n - full, filled)
            add(room - each * length, full, [*filled, (length, each)])
            left -= full * each
    runs, used, first = [], dict.fromkeys(counts, 0), 0
    for groups in open_.values():
        for n, filled in groups:
            offset = 0
            for length, each in filled:
                for _ in range(each):
                    runs.append((length, used[length], used[length] + n, first, offset))
                    used[length] += n
                    offset += length
            first += n
    return sorted(runs)


def pack(pieces: DataFrame, capacity: int = 4096, id_col: str = "doc_id", length_col: str = "length", seed: int = 0) -> DataFrame:
    """The pieces (a written table, lengths 1..capacity) with ``sequence_id`` and
    ``offset``. Columns of these names must not be there already."""
    spark = pieces.sparkSession
    counts = {int(n): int(c) for n, c in pieces.groupBy(length_col).agg(F.count(F.lit(1))).collect()}  # <= capacity rows
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("a piece is empty or longer than the capacity")
    runs = np.array(plan(counts, capacity), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(runs)  # its size depends on the capacity alone
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        starts = r[:, 0] * (1 << 48) + r[:, 1]
        for b in batches:
            rank = b.column(len(names)).to_numpy()
            k = np.searchsorted(starts, b.column(names.index(length_col)).to_numpy().astype(np.int64) * (1 << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(r[k, 3] + rank - r[k, 1]), pa.array(r[k, 4])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "sequence_id long", "offset long"])
    ranked = rank_within(pieces, [length_col], id_col, "__rank", seed)
    return ranked.select(*names, "__rank").mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id`` and their ids in order (at most
    ``capacity`` of them), from packed pieces that carry ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, **kw) -> DataFrame:
    """Pieces of all documents with their place. ``ids`` stay in the written
    pieces; digests and places travel without them."""
    pieces = written(cut_pieces(docs, tokenizer, capacity=capacity, **kw), "pieces")
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
