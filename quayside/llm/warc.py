"""WARC archives: write pages, read them back, reassemble segments.

``write`` finds equal payloads by digest (a partially aggregated minimum over
digests; only digests met twice are joined back), and each task writes its pages
as gzip members, one per record, rolling to a new file by size. A response's
block is an HTTP message with chunked transfer framing; a block beyond
``segment_bytes`` is cut into the origin record and continuation records, which
may lie in other files. A revisit holds the HTTP header alone.

``read`` parses files record by record. Whole responses are decoded at once;
segments are grouped by origin identifier, ordered by segment number, checked for
gaps and against the total length, joined and decoded. Payloads are checked
against their digest; any mismatch raises. A group is one page's block, so its
size is that of the page.

Records have identifiers of their own (by file and place), so repeated rows stay
apart; page ids are kept in extension fields, also for what a revisit refers to.

Defined cases. A null payload is empty, a null url gives no target. Null page ids
are written as such; one never becomes the page that others refer to. Rows that
repeat one page id and payload are responses each. Empty pages and payloads below
``least`` bytes are always responses. An empty table gives an empty result. Only
id, url and html are read, so other names cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm.common import shared_path, written
from quayside.llm.files import opened, published

DATE = "2024-01-01T00:00:00Z"
FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_types(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = 100) -> DataFrame:
    """page_id, url, payload and digest of every row, and ``refers_to``: the
    smallest id with the same payload, where that is another page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    same = written(rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("digest")
                   .agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last").drop("last"), "same-payload")
    joined = rows.join(same, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest",
                         F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """Chunked transfer framing."""
    out = []
    for i in range(0, len(payload), chunk_bytes):
        part = payload[i:i + chunk_bytes]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            break
        if body[at + n:at + n + 2] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[at:at + n])
        at += n + 2
    while (end := body.index(b"\r\n", at)) != at:  # trailers
        at = end + 2
    if end + 2 != len(body):
        raise ValueError("bytes after the last chunk")
    return b"".join(out)


def record(kind: str, name: str, block: bytes, fields: dict[str, object]) -> bytes:
    """One record as a gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": DATE, "Content-Type": "application/http; msgtype=response",
            **{k: v for k, v in fields.items() if v is not None}, "Content-Length": len(block)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    pack = zlib.compressobj(1, wbits=31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def records(page_id, url, payload: bytes, digest: str, refers_to, place: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, place)
    url = None if url is None else "".join(c for c in url if c.isprintable())
    fields = {"WARC-Target-URI": url, "X-Page-ID": page_id, "WARC-Payload-Digest": f"sha256:{digest}"}
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record("revisit", name, f"{head}Content-Length: {len(payload)}\r\n\r\n".encode(),
                     {**fields, "WARC-Profile": profile, "X-Refers-To-Page-ID": refers_to})
        return
    block = f"{head}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        yield record("response", name, block, fields)
        return
    parts = range(0, len(block), segment_bytes)
    yield record("response", name, block[:segment_bytes], {**fields, "WARC-Segment-Number": 1})
    for k, at in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}
        yield record("continuation", uuid.uuid5(name, str(k)), block[at:at + segment_bytes],
                     {"WARC-Segment-Origin-ID": f"<urn:uuid:{name}>", "WARC-Segment-Number": k, **last})


def write(pages: DataFrame, folder: str | None = None, segment_bytes: int = 1 << 16, chunk_bytes: int = 1 << 13,
          file_bytes: int = 1 << 28, **kw) -> str:
    """Write the archives and a manifest of their names; the folder."""
    folder = folder or shared_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names, row = TaskContext.get().partitionId(), [], 0
        todo = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        page = next(todo, None)
        while page is not None:
            name = f"part-{task:06d}-{len(names):04d}.warc.gz"
            with published(f"{folder}/{name}") as out:
                size = 0
                while size < file_bytes and page is not None:
                    for x in records(*page, f"{folder}/{task}/{row}", segment_bytes, chunk_bytes):
                        size += out.write(x)
                    row, page = row + 1, next(todo, None)
            names.append(name)
        yield pa.RecordBatch.from_pydict({"file": pa.array(names, pa.string())})

    with_types(pages, **kw).mapInArrow(run, "file string").write.parquet(f"{folder}/manifest")
    return folder


def parsed(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a file, read as a stream."""
    store, name = opened(path)
    with store.open_input_stream(name, compression=None) as f:
        unpack, got, rest = zlib.decompressobj(wbits=31), [], f.read(1 << 20)
        while rest:
            got.append(unpack.decompress(rest))
            if unpack.eof:
                data = b"".join(got)
                head, _, tail = data.partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                fields = dict(x.split(": ", 1) for x in lines[1:])
                n = int(fields["Content-Length"])
                if lines[0] != "WARC/1.1" or tail[n:] != b"\r\n\r\n":
                    raise ValueError(f"{path} has a broken record")
                yield fields, tail[:n]
                rest, unpack, got = unpack.unused_data or f.read(1 << 20), zlib.decompressobj(wbits=31), []
            else:
                rest = f.read(1 << 20)
        if got:
            raise ValueError(f"{path} ends inside a record")


def _message(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return dict(x.lower().split(": ", 1) for x in head.decode().split("\r\n")[1:]), body


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def payload_of(block: bytes, digest: str) -> bytes:
    """The checked payload of a whole response block."""
    head, body = _message(block)
    payload = unchunked(body) if head.get("transfer-encoding") == "chunked" else body
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload does not match its digest")
    return payload


def read(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, payload (null for revisits)."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "origin", "segment", "total", "block"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for file in b.column(0).to_pylist():
                rows, size = [], 0
                for f, block in parsed(f"{folder}/{file}"):
                    kind, digest = f["WARC-Type"], f.get("WARC-Payload-Digest", "").removeprefix("sha256:")
                    page, refers = _number(f.get("X-Page-ID")), _number(f.get("X-Refers-To-Page-ID"))
                    if kind == "revisit":
                        rows.append((page, int(_message(block)[0]["content-length"]), digest, kind, refers, None, None, None, None, None))
                    elif "WARC-Segment-Number" in f:
                        origin = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
                        rows.append((page, None, digest, kind, None, None, origin, int(f["WARC-Segment-Number"]), _number(f.get("WARC-Segment-Total-Length")), block))
                        size += len(block)
                    else:
                        payload = payload_of(block, digest)
                        rows.append((page, len(payload), digest, kind, None, payload if with_payload else None, None, None, None, None))
                        size += len(payload) * with_payload
                    if len(rows) >= 1000 or size > 1 << 25:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                page, digest, total, parts = (c[i].as_py() for c in b.columns)
                numbers, blocks = [x["segment"] for x in parts], [x["block"] for x in parts]
                if numbers != list(range(1, len(numbers) + 1)) or total != sum(map(len, blocks)):
                    raise ValueError("a segmented record is not whole")
                payload = payload_of(b"".join(blocks), digest)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(
                    (page, len(payload), digest, "response", None, payload if with_payload else None), kinds)], names=names[:6])

    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = f"{FOUND}, payload binary, origin string, segment int, total long, block binary"
    found = written(spark.read.schema("file string").parquet(f"{folder}/manifest").repartition(n).mapInArrow(run, schema), "warc-records")
    first = F.col("segment") == 1
    groups = found.where("origin IS NOT NULL").groupBy("origin").agg(
        F.max(F.when(first, F.col("page_id"))).alias("page_id"), F.max(F.when(first, F.col("payload_digest"))).alias("digest"),
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
    whole = groups.select("page_id", "digest", "total", "parts").mapInArrow(joined, f"{FOUND}, payload binary")
    out = found.where("origin IS NULL").select(*names[:6]).unionByName(whole)
    return out if with_payload else out.drop("payload")
