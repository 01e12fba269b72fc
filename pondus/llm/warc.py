"""WARC archives: one gzip member per record, and a sequential reader that checks them.

Writer: each page becomes one record, compressed on its own.  Pages with equal payloads (by
SHA-1 and length, at least ``least`` bytes) share one ``response`` record, that of the
largest page_id; the others are ``revisit`` records that refer to it and carry no payload.
An archive is the concatenation of its members.  Tasks write it as a table of segments
(archive, part, data) of whole members, which works on any store that Spark writes, and
whose commit makes retries safe; ``export`` puts an archive's segments into a ``.warc.gz``.

Reader: bytes come in pieces of any size, members are decompressed incrementally, records
are framed by Content-Length, and block and payload digests are verified.  At most one
record is held at a time.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import if_small, written

SEGMENT = 4 << 20
_PIECE = 1 << 16
# Fixed values of the format.
_VERSION = b"WARC/1.1"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{payload_digest}>"


def _page_of(record_id: str | None) -> int | None:
    m = re.match(r"<urn:page:(-?[0-9]+):", record_id or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One record as a gzip member."""
    own = digest(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id, own)), ("WARC-Date", _DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    if revisit:
        head += [("WARC-Profile", _IDENTICAL), ("WARC-Refers-To", _record_id(refers_to, own))]
    head += [("WARC-Payload-Digest", f"sha1:{own}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = _VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(text) + c.flush()


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes
    #: None, or what is wrong with the record.
    error: str | None

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.headers.get("content-type", "").startswith("application/http") else self.block


def _members(pieces: Iterable[bytes]) -> Iterator[tuple[bytes, str | None]]:
    """(bytes, error) of each gzip member of a stream."""
    z, out, fed = zlib.decompressobj(31), bytearray(), False
    for piece in pieces:
        while piece:
            fed = True
            try:
                out += z.decompress(piece)
            except zlib.error as e:
                yield bytes(out), f"gzip: {e}"
                return  # the next member's start is unknown
            piece = z.unused_data
            if z.eof:
                yield bytes(out), None
                z, out, fed = zlib.decompressobj(31), bytearray(), False
    if fed:
        yield bytes(out), "gzip: the stream ends within a member"


def read_records(pieces: Iterable[bytes]) -> Iterator[Record]:
    """The records of a stream of gzip members; a faulty one has its error and isn't hidden."""
    for data, error in _members(pieces):
        head, sep, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "")
        if error is None and (not sep or not lines[0].startswith("WARC/")):
            error = "no WARC header"
        elif error is None and not length.isdecimal():
            error = "no Content-Length"
        block = rest[:int(length)] if length.isdecimal() else rest
        if error is None and rest[len(block):] != b"\r\n\r\n" or error is None and len(block) != int(length):
            error = "the block doesn't have its Content-Length"
        r = Record(headers, block, error)
        if error is None and (said := headers.get("warc-block-digest")) and said != f"sha1:{digest(block)}":
            r = r._replace(error="block digest")
        elif error is None and headers.get("warc-type") != "revisit" and (said := headers.get("warc-payload-digest")) and said != f"sha1:{digest(r.payload())}":
            r = r._replace(error="payload digest")
        yield r


def _write(batches, segment: int):
    archive = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
    part, data = 0, bytearray()
    for batch in batches:
        for page, url, html, refers_to, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit"))):
            data += record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), revisit.as_py())
            if len(data) >= segment:
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([part], pa.int32()), pa.array([bytes(data)], pa.binary())], ["archive", "part", "data"])
                part, data = part + 1, bytearray()
    if data:
        yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([part], pa.int32()), pa.array([bytes(data)], pa.binary())], ["archive", "part", "data"])


def write_archives(pages: DataFrame, least: int = 0, segment: int = SEGMENT) -> DataFrame:
    """A record for each row of ``pages`` (page_id, url, html), as a written table (archive,
    part, data) in the shared folder.

    A null html is an empty payload, a null url leaves its header out.  Of equal payloads of
    at least ``least`` bytes, the rows with the largest page_id are responses (all of them, if
    that id repeats) and the others revisits; a null id is smaller than any other.  Extra
    columns are ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = pages.withColumns({"_sha1": F.sha1("html"), "_bytes": F.octet_length("html")})
    largest = written(keyed.filter(F.col("_bytes") >= least).groupBy("_sha1", "_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n"))
                      .filter("_n > 1").drop("_n"), "payloads")
    rows = keyed.join(if_small(largest), ["_sha1", "_bytes"], "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return written(rows.select("page_id", "url", "html", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))
                   .mapInArrow(lambda it: _write(it, segment), "archive string, part int, data binary"), "warc")


def _pieces(data) -> Iterator[bytes]:
    view = memoryview(data)
    for a in range(0, len(view), _PIECE):
        yield bytes(view[a:a + _PIECE])


_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                      ("refers_to", pa.int64()), ("url", pa.string()), ("error", pa.string())])


def _read(batches):
    for batch in batches:
        for data in batch.column("data"):
            rows = []
            for r in read_records(_pieces(data.as_buffer())):
                http = r.block.partition(b"\r\n\r\n")[0].decode("utf-8", "replace")
                said = re.search(r"(?im)^content-length:\s*([0-9]+)", http)
                h = r.headers
                rows.append({"page_id": _page_of(h.get("warc-record-id")), "payload_bytes": int(said[1]) if said and h.get("warc-type") == "revisit" else len(r.payload()),
                             "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "record_type": h.get("warc-type"),
                             "refers_to": _page_of(h.get("warc-refers-to")), "url": h.get("warc-target-uri"), "error": r.error})
            yield from pa.Table.from_pylist(rows, _RECORDS).to_batches()


def read_archives(segments: DataFrame) -> DataFrame:
    """A row for each record of a table with a column ``data`` of whole gzip members: page_id,
    payload_bytes, payload_digest, record_type, refers_to, url, error (null if all digests
    and lengths hold)."""
    return segments.select("data").mapInArrow(
        _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, error string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``.warc.gz`` files, one file a task."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("content").alias("data")))


def export(segments: DataFrame, folder: str) -> DataFrame:
    """Write each segment as a ``.warc.gz`` of its own into ``folder``, which all executors must
    have mounted; (file, bytes).  A retry replaces the file by one with the same bytes."""
    def put(batches):
        for batch in batches:
            names, sizes = [], []
            for archive, part, data in zip(*(batch.column(c) for c in ("archive", "part", "data"))):
                name = os.path.join(folder, f"{archive.as_py()}-{part.as_py():05d}.warc.gz")
                with open(own := f"{name}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data.as_buffer())
                os.replace(own, name)
                names.append(name)
                sizes.append(len(data.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["file", "bytes"])
    return segments.mapInArrow(put, "file string, bytes long")


#: The result of writing and reading in DuckDB SQL (least = 0).
SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
bits AS (
  SELECT *, list_reduce(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][instr('0123456789abcdef', h[i])]), lambda a, b: a || b) AS b FROM p),
named AS (
  SELECT *, list_reduce(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * (b[5 * i + 1])::INT + 8 * (b[5 * i + 2])::INT + 4 * (b[5 * i + 3])::INT + 2 * (b[5 * i + 4])::INT + (b[5 * i + 5])::INT]), lambda a, c: a || c) AS payload_digest FROM bits),
top AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS best FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM best AND best IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to FROM top
"""
