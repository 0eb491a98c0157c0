"""Token-id files: static rANS blocks with checkpoints and checksums.

``write`` encodes whole documents once into a written table and counts the ids in
the same pass (one shared frequency table, at most a row per id of the vocabulary),
orders the documents by id, then by a hash of the text, with a range partitioning
and writes one file per partition. ``read`` turns the files' checkpoints into units
of a few blocks that tasks decode in parallel.

A file: header (magic, crc32 of the frequency table); blocks of up to BLOCK ids,
each coded on its own; the document index (id, present, number of ids); the
checkpoints, one per block: place, bytes, number of ids, first id's position in
the file, the first document that begins in or after the block and where, crc32
of its ids, crc32 of the index rows of the documents that begin in it; the trailer
with counts and the crc32 of the checkpoints. Documents follow one another without
regard to blocks. The frequency table lies beside the files. A unit is handed its
checkpoints, reads the index rows of the documents that begin in its blocks, decodes
those, and reads on where the last of them ends later: every part of a file is read
once, however large it is.

Defined cases. Null and empty texts have the end id alone. Documents with null
ids come first; several texts under one id are in the order of their hashes, so an
id that very many rows share spans several files. Repeated rows are stored and
returned one by one. Texts are encoded whole; a long one spans many blocks. An empty
table makes files without documents and an empty result. Only the id and text
columns are read, so other names cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import rans
from quayside.llm.common import shared_path, written
from quayside.llm.files import opened, published
from quayside.llm.tokens import Encoder, encoder, id_width, vocabulary

MAGIC = b"QTOKENS2"
BLOCK = 1 << 18
UNIT = 8  # blocks
_HEADER = struct.Struct("<8sI")
_TRAILER = struct.Struct("<QQQQQI8s")  # documents, blocks, ids, places of index and checkpoints, crc32, magic
_DOC = np.dtype([("id", "<i8"), ("present", "u1"), ("n", "<u8")])
_POINT = np.dtype([("at", "<u8"), ("bytes", "<u4"), ("n", "<u4"), ("first", "<u8"), ("doc", "<u8"), ("doc_at", "<u8"), ("crc32", "<u4"), ("docs_crc32", "<u4")])


def encoded(docs: DataFrame, tokenizer: str, end_id: int = 2, spaces: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, ids, id, n): per document its ids with the end id, as numbers of
    the vocabulary's width, and a hash of its text; and per task rows without ``ids``
    that hold how often each id occurs there."""
    file_text, width = vocabulary(docs.sparkSession, tokenizer), id_width(tokenizer, end_id)
    end = np.array([end_id], width).tobytes()
    names = ["doc_id", "key", "ids", "id", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(Encoder, file_text.value, spaces, width, True), np.zeros(1 << 16, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [x + end for x in own.ids_of(part.column(2).to_pylist())]
                some = np.bincount(np.frombuffer(b"".join(ids), width))
                if len(some) > len(seen):
                    seen = np.pad(seen, (0, 2 * len(some) - len(seen)))
                seen[:len(some)] += some
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary()), none, none], names=names)
        k = np.flatnonzero(seen)
        none = pa.nulls(len(k), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(k), pa.binary()), pa.array(k), pa.array(seen[k])], names=names)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, key long, ids binary, id long, n long"))


def frequencies(table: DataFrame) -> np.ndarray:
    """Counts of all ids, normalised."""
    rows = table.where("id IS NOT NULL").groupBy("id").agg(F.sum("n")).collect()  # <= vocabulary
    counts = np.zeros(max((r[0] for r in rows), default=0) + 1, np.int64)
    for k, n in rows:
        counts[k] = n
    return rans.normalised(counts)


class _File:
    """Writes one file as documents come in."""

    def __init__(self, out, table: rans.Table):
        self.out, self.table = out, table
        self.docs, self.points, self.held, self.n_held = [], [], [], 0
        self.n, self.cut, self.at = 0, 0, out.write(_HEADER.pack(MAGIC, table.crc32))

    def add(self, doc, ids: np.ndarray) -> None:
        self.docs.append((doc or 0, doc is not None, len(ids)))
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            rest = np.concatenate(self.held)
            while len(rest) >= BLOCK:
                self.block(rest[:BLOCK])
                rest = rest[BLOCK:]
            self.held, self.n_held = [rest], len(rest)

    def block(self, ids: np.ndarray) -> None:
        data = rans.encode(ids, self.table)
        self.points.append((self.at, len(data), len(ids), self.cut, 0, 0, zlib.crc32(ids.astype("<u4")), 0))
        self.at += self.out.write(data)
        self.cut += len(ids)

    def close(self) -> tuple[int, int]:
        if self.n_held:
            self.block(np.concatenate(self.held))
        docs, points = np.array(self.docs, _DOC), np.array(self.points, _POINT)
        starts = np.concatenate([np.zeros(1, np.uint64), np.cumsum(docs["n"], dtype=np.uint64)])
        points["doc"] = np.searchsorted(starts[:-1], points["first"])
        points["doc_at"] = starts[points["doc"].astype(np.int64)]
        ends = np.append(points["doc"][1:], len(docs)).astype(np.int64)
        for k, p in enumerate(points):
            points["docs_crc32"][k] = zlib.crc32(docs[int(p["doc"]):ends[k]].tobytes())
        self.out.write(docs.tobytes() + points.tobytes() + _TRAILER.pack(
            len(docs), len(points), self.n, self.at, self.at + docs.nbytes, zlib.crc32(points.tobytes()), MAGIC))
        return len(docs), self.n


def write(docs: DataFrame, tokenizer: str, folder: str | None = None, files: int | None = None, end_id: int = 2, **kw) -> str:
    """Write the documents' ids, in ascending id order; the folder."""
    spark = docs.sparkSession
    folder, width = folder or shared_path(spark, "token-files"), id_width(tokenizer, end_id)
    ids = written(encoded(docs, tokenizer, end_id, **kw), "token-ids")
    freq = frequencies(ids)
    with published(f"{folder}/frequencies") as out:
        out.write(freq.astype("<u4").tobytes())
    shared = spark.sparkContext.broadcast(freq)  # a number per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = TaskContext.get().partitionId()
        with published(f"{folder}/part-{k:06d}.tok") as out:
            file = _File(out, rans.Table.of(shared.value))
            for b in batches:
                for doc, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    file.add(doc, np.frombuffer(data, width))
            n_docs, n = file.close()
        yield pa.RecordBatch.from_pydict({"file": [k], "docs": [n_docs], "n": [n]})

    n = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = (ids.where("ids IS NOT NULL").select("doc_id", "ids", "key").repartitionByRange(n, "doc_id", "key")
            .sortWithinPartitions("doc_id", "key").select("doc_id", "ids").mapInArrow(run, "file long, docs long, n long"))
    rows.write.parquet(f"{folder}/manifest")
    return folder


def _head(f) -> tuple[bytes, int]:
    return _HEADER.unpack(f.read_at(_HEADER.size, 0))


def _points(store, name: str) -> tuple[np.ndarray, int, int]:
    """The checkpoints, checked, the number of documents and the index's place."""
    with store.open_input_file(name) as f:
        end = f.size()
        n_docs, n_blocks, n, docs_at, at, crc, magic = _TRAILER.unpack(f.read_at(_TRAILER.size, end - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is not whole")
        points = f.read_at(end - _TRAILER.size - at, at)
    if zlib.crc32(points) != crc:
        raise ValueError(f"{name} has damaged checkpoints")
    return np.frombuffer(points, _POINT), n_docs, docs_at


def _units(path: str) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Per unit the index's place, the documents that begin in it (first, last), its
    number of blocks and the checkpoints of the blocks these documents lie in, its own
    first."""
    points, n_docs, docs_at = _points(*opened(path))
    for lo in range(0, len(points), UNIT):
        hi = lo + UNIT
        first, last = int(points[lo]["doc"]), int(points[hi]["doc"]) if hi < len(points) else n_docs
        if last > first:
            # the last document ends where the next one begins: in a block that begins before that
            end = int(np.searchsorted(points["first"], points[hi]["doc_at"])) if hi < len(points) else len(points)
            yield docs_at, first, last, min(UNIT, len(points) - lo), points[lo:max(hi, end)].tobytes()


def _index(f, name: str, docs_at: int, first: int, last: int, points: np.ndarray) -> np.ndarray:
    """The index rows of a unit's documents, checked against its checkpoints."""
    docs = np.frombuffer(f.read_at((last - first) * _DOC.itemsize, docs_at + first * _DOC.itemsize), _DOC)
    ends = np.append(points["doc"][1:].astype(np.int64), last)
    for p, end in zip(points, ends):
        if zlib.crc32(docs[int(p["doc"]) - first:int(end) - first].tobytes()) != int(p["docs_crc32"]):
            raise ValueError(f"{name} has a damaged index")
    return docs


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before
    it), n_tokens, ids_crc32 and, if asked for, ids."""
    files = sorted((r["file"], r["n"]) for r in spark.read.parquet(f"{folder}/manifest").collect())  # a row per file
    starts = np.concatenate([[0], np.cumsum([n for _, n in files], dtype=np.int64)])
    todo = spark.createDataFrame([(f"{folder}/part-{k:06d}.tok", int(s)) for (k, _), s in zip(files, starts)], "file string, base long")
    store, name = opened(f"{folder}/frequencies")
    with store.open_input_file(name) as f:
        shared = spark.sparkContext.broadcast(np.frombuffer(f.read(), "<u4").astype(np.uint64))

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(*(c.to_pylist() for c in b.columns)):
                rows = [(path, base, *u) for u in _units(path)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (
                    pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["file", "base", "docs_at", "first", "last", "blocks", "points"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table.of(shared.value)
        for b in batches:
            for path, base, docs_at, first, last, own, points in zip(*(c.to_pylist() for c in b.columns)):
                store, name = opened(path)
                points = np.frombuffer(points, _POINT)
                with store.open_input_file(name) as f:
                    if _head(f) != (MAGIC, table.crc32):
                        raise ValueError(f"{name} belongs to another frequency table")
                    docs = _index(f, name, docs_at, first, last, points[:own])
                    yield from _documents(f, docs, points, table, base, with_ids)

    def _documents(f, docs, points, table, base, with_ids):
        position = int(points[0]["doc_at"])
        block, at = 0, int(points[0]["first"])  # at: position of the next id that is not decoded
        held, offset, out, size = None, 0, [], 0
        for doc, present, n in docs.tolist():
            left, crc, parts = n, 0, []
            while left:
                if held is None or offset >= len(held):
                    p = points[block]
                    block += 1
                    if position - at >= int(p["n"]):  # a block that lies wholly in an earlier document
                        at += int(p["n"])
                        continue
                    held = rans.decode(f.read_at(int(p["bytes"]), int(p["at"])), int(p["n"]), table)
                    if zlib.crc32(held) != int(p["crc32"]):
                        raise ValueError("a block's ids do not match its checksum")
                    offset = max(0, position - at)
                    at += int(p["n"])
                x = held[offset:offset + left]
                crc = zlib.crc32(x, crc)
                if with_ids:
                    parts.append(x.tobytes())
                    size += x.nbytes
                offset, left = offset + len(x), left - len(x)
            out.append((doc if present else None, base + position, n, crc, b"".join(parts)))
            position += n
            if len(out) >= 4096 or size > 1 << 26:
                yield batch(out)
                out, size = [], 0
        yield batch(out)

    def batch(out):
        cols = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        keep = 5 if with_ids else 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:keep], kinds)], names=names[:keep])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    each = "file string, base long, docs_at long, first long, last long, blocks int, points binary"
    return todo.repartition(n).mapInArrow(units, each).repartition(n).mapInArrow(run, schema)
