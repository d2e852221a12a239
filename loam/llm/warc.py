"""WARC archives: writing records, normalising monolithic gzip files, reading by offset.

A monolithic archive is one gzip stream over all of its records, which cannot be entered in the middle. The normaliser
inflates that stream once, front to back, rewrites every record as a gzip member of its own and notes each member's
offset and length in a sidecar index, by which single records can then be read. Streams are handled in pieces of
PIECE bytes, so memory does not depend on a record's or an archive's size.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PIECE = 1 << 20
LEVEL = 3
EPOCH = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit carries no payload, only its digest and length."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + _urn(page_id), b"WARC-Date: " + EPOCH.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"X-Payload-Length: %d" % len(payload)]
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: " + _urn(refers_to)]
    block = _HTTP + (b"" if kind == "revisit" else payload)
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


class Inflated:
    """Reads a gzip file of one or many members as one stream of plain bytes, a piece at a time."""

    def __init__(self, source: BinaryIO):
        self.source, self.z, self.plain, self.raw, self.fed = source, zlib.decompressobj(31), bytearray(), b"", False

    def _more(self) -> bool:
        if self.z.eof:
            rest = self.z.unused_data or self.source.read(PIECE)
            rest = rest.lstrip(b"\0")
            if not rest:
                return False
            self.z, self.raw = zlib.decompressobj(31), rest
        elif not self.raw:
            self.raw = self.source.read(PIECE)
            if not self.raw:
                if self.fed:
                    raise EOFError("the gzip stream is cut off")
                return False
            self.fed = True
        got = self.z.decompress(self.raw, PIECE)
        self.raw = self.z.unconsumed_tail
        self.plain += got
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and with the mark; empty at the end of the stream."""
        at = 0
        while (k := self.plain.find(mark, at)) < 0:
            at = max(0, len(self.plain) - len(mark))
            if not self._more():
                if self.plain.strip():
                    raise EOFError("no end of a record's head")
                return b""
        out = bytes(self.plain[: k + len(mark)])
        del self.plain[: k + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.plain and not self._more():
                raise EOFError("a record is cut off")
            out = bytes(self.plain[: min(n, PIECE)])
            del self.plain[: len(out)]
            n -= len(out)
            if out:
                yield out


def header(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


def normalise(source: BinaryIO, target: BinaryIO) -> Iterator[tuple[str, str, int, int]]:
    """Rewrite a gzipped WARC record by record; yields (record id, type, offset, length) for the sidecar index.

    An empty source gives an empty target; a cut-off one raises EOFError.
    """
    plain, offset = Inflated(source), 0
    while head := plain.until(b"\r\n\r\n"):
        z, length = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> int:
            target.write(data)
            return len(data)

        head = head.lstrip(b"\r\n")
        length += put(z.compress(head))
        for piece in plain.pieces(int(header(head, b"Content-Length") or 0)):
            length += put(z.compress(piece))
        tail = b"".join(plain.pieces(4))
        length += put(z.compress(tail)) + put(z.flush())
        yield header(head, b"WARC-Record-ID") or "", header(head, b"WARC-Type") or "", offset, length
        offset += length


def read_member(data: bytes | memoryview, offset: int, length: int) -> tuple[bytes, bytes]:
    """Head and block of the record whose member stands at an offset of the index."""
    plain = zlib.decompress(data[offset : offset + length], 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    return head, rest[: int(header(head, b"Content-Length") or 0)]


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest_hex, refers_to): refers_to is the largest page of an equal payload, or null for itself.

    Only digests met more than once are joined, after partial aggregation; a large group of copies is one row there.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest_hex", F.sha1("payload"))
    big = p.where(F.octet_length("payload") >= min_bytes)
    shared = big.groupBy("digest_hex").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest_hex", "target")
    told = F.when((F.octet_length("payload") >= min_bytes) & ~F.col("target").eqNullSafe(F.col("page_id")), F.col("target"))
    return p.join(shared, "digest_hex", "left").select("page_id", "url", "payload", told.alias("refers_to"))


_ARCHIVE = pa.schema([("archive", pa.string()), ("content", pa.binary())])
_NORMAL = "archive string, content binary, index array<struct<record_id:string, record_type:string, offset:bigint, length:bigint>>"
_ENTRY = pa.struct([("record_id", pa.string()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _write(batches):
    part = TaskContext.get().partitionId()
    for n, b in enumerate(batches):
        out = io.BytesIO()
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for page, url, payload, refers in zip(*(b.column(k) for k in range(4)), strict=True):
            data, ref, page = payload.as_py(), refers.as_py(), page.as_py()
            out.write(z.compress(record("response" if ref is None else "revisit", page, url.as_py(), data, sha1_base32(data), ref)))
        if b.num_rows:
            out.write(z.flush())
            yield pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{n:06d}.warc.gz"]), pa.array([out.getvalue()], pa.binary())], schema=_ARCHIVE)


def write_archives(records: DataFrame) -> DataFrame:
    """(archive, content): monolithic gzip archives, each of one Arrow batch of records; store it before it is read twice."""
    return records.mapInArrow(_write, "archive string, content binary")


def _normalise(batches):
    for b in batches:
        for name, content in zip(b.column("archive"), b.column("content"), strict=True):
            out = io.BytesIO()
            index = [dict(zip(("record_id", "record_type", "offset", "length"), x, strict=True)) for x in normalise(io.BytesIO(content.as_py()), out)]
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([out.getvalue()], pa.binary()), pa.array([index], pa.list_(_ENTRY))], names=["archive", "content", "index"])


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(archive, content, index): the same records as members of their own, with the sidecar index of each archive.

    Works on any table with those two columns, such as binaryFile reads renamed to them.
    """
    return archives.select("archive", "content").mapInArrow(_normalise, _NORMAL)


def sidecar(normal: DataFrame) -> DataFrame:
    """(archive, record_id, record_type, offset, length): the index of normalised archives as a table of its own, a row for each record."""
    return normal.select("archive", F.explode("index").alias("e")).select("archive", "e.*")


def entries(index: DataFrame) -> DataFrame:
    """(archive, index): a sidecar's rows by archive, in order; an archive is one batch of records."""
    e = F.struct("offset", "record_id", "record_type", "length")
    of = F.transform(F.array_sort(F.collect_list(e)), lambda x: F.struct(x["record_id"].alias("record_id"), x["record_type"].alias("record_type"), x["offset"].alias("offset"), x["length"].alias("length")))
    return index.groupBy("archive").agg(of.alias("index"))


def _number(urn: str | None) -> int | None:
    digits = (urn or "").rpartition(":")[2].rstrip(">")
    return int(digits) if digits else None


def _read(keep_payload: bool):
    def run(batches):
        for b in batches:
            for content, index in zip(b.column("content"), b.column("index"), strict=True):
                data, rows = memoryview(content.as_buffer()), []
                for e in index.as_py():
                    head, block = read_member(data, e["offset"], e["length"])
                    kind, digest, n = e["record_type"], (header(head, b"WARC-Payload-Digest") or "")[5:], int(header(head, b"X-Payload-Length") or 0)
                    payload = None
                    if kind == "response":
                        payload = block[len(_HTTP) :]
                        n, found = len(payload), sha1_base32(payload)
                        if found != digest:
                            raise ValueError(f"{e['record_id']}: payload and digest differ")
                    rows.append((_number(e["record_id"]), header(head, b"WARC-Target-URI"), payload if keep_payload else None, n, digest, kind, _number(header(head, b"WARC-Refers-To"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)

    return run


def read_archives(normal: DataFrame, keep_payload: bool = True) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to): each record from its own member.

    A response's digest is checked against its bytes. A revisit's payload is null; its length and digest are those of
    the full payload it stands for.
    """
    return normal.mapInArrow(_read(keep_payload), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write archives of all pages, normalise them, write the sidecar index, and read them back by its entries.

    Null html is an empty payload, a null url leaves its header out, a null page_id has a record without a number (and
    revisits the page of an equal payload, if one has an id). Repeated rows are records of their own. Other columns are
    ignored. An empty table gives no archive and no row.
    """
    common.prepare(pages.sparkSession)
    mono = common.written(write_archives(plan_records(pages, id_col, url_col, html_col, min_bytes)), "warc")
    normal = common.written(normalise_archives(mono), "members")
    common.free(mono)
    common.written(sidecar(normal), "sidecar")
    return read_archives(normal, keep_payload=False)  # each archive beside its own entries, so no content is moved
