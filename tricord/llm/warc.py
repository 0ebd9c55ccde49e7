"""Operator 5: WARC archives, one gzip member per record, and a sequential reader.

``write_warc`` writes a response record per page, or a revisit record (identical payload digest)
for a page whose payload another response of the same run holds: of equal payloads of at least
``min_revisit`` bytes, the page with the largest id is the response. ``WarcReader`` reads a stream
front to back: it inflates piece by piece, takes the record's header, frames the block by its
content length, checks that the gzip member ends there, and verifies block and payload digests.

Rows: a null payload is an empty one; a null page id counts as the smallest, and where equal payloads
have no other id each of them is a response; of repeated rows with the largest id each is a response and refers to itself by that id; other columns are ignored; an
empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, file_system, materialize

READ = 1 << 16
OWN_ID = re.compile(r"<urn:page:(-?\d+)>")
RETURNED = ("response", "revisit", "resource")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, level: int = 6) -> bytes:
    """The response record of a page, or its revisit record if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    # the page id in the record's id, so that a reader needs no header of our own
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", quote(url or "urn:none", safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    return record_bytes(headers, block, level)


class WarcReader:
    """Iterates over (headers, HTTP headers, payload) of the records of a stream with ``read(n)``."""

    def __init__(self, stream):
        self.stream, self.raw, self.z, self.plain = stream, b"", None, bytearray()

    def _more(self) -> bool:
        """Inflate another piece of the member at hand; False at its end."""
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(READ)
            if not self.raw:
                raise ValueError("the archive ends inside a record")
        self.plain += self.z.decompress(self.raw)
        self.raw = self.z.unused_data
        return True

    def _until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.plain.find(mark, seen)) < 0:
            seen = max(0, len(self.plain) - len(mark))
            if not self._more():
                raise ValueError("a record without an end of its header")
        found = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return found

    @staticmethod
    def _fields(lines: list[bytes]) -> dict[str, str]:
        pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if x)
        return {k.strip().lower(): v.strip() for k, _, v in pairs}

    def __iter__(self) -> Iterator[tuple[dict, dict, bytes]]:
        while self.raw or (raw := self.stream.read(READ)):
            self.raw = self.raw or raw
            self.z, self.plain = zlib.decompressobj(31), bytearray()
            first, *lines = self._until(b"\r\n\r\n").split(b"\r\n")
            if not first.startswith(b"WARC/1."):
                raise ValueError(f"not a WARC record: {first[:20]!r}")
            headers = self._fields(lines)
            if not headers.get("content-length", "").isdigit():
                raise ValueError("a record without a content length")
            length = int(headers["content-length"])
            while len(self.plain) < length + 4:
                if not self._more():
                    raise ValueError("a record shorter than its content length")
            while self._more():
                pass
            if self.plain[length:] != b"\r\n\r\n":
                raise ValueError("a record longer than its content length")
            block = bytes(self.plain[:length])
            self._verify(headers.get("warc-block-digest"), block)
            http, payload = {}, block
            if headers.get("content-type", "").startswith("application/http"):
                head, _, payload = block.partition(b"\r\n\r\n")
                http = self._fields(head.split(b"\r\n")[1:])
            if headers.get("warc-type") != "revisit":
                self._verify(headers.get("warc-payload-digest"), payload)
            yield headers, http, payload

    @staticmethod
    def _verify(said: str | None, data: bytes) -> None:
        """Digests are ``algorithm:value``, base 32 or hexadecimal; those of an algorithm that Python doesn't have can't be verified."""
        kind, _, value = (said or "").partition(":")
        kind = kind.lower().replace("sha-", "sha")
        if kind not in hashlib.algorithms_guaranteed or kind.startswith("shake"):
            return
        made = hashlib.new(kind, data).digest()
        if value.lower() != made.hex() and value.upper().rstrip("=") != base64.b32encode(made).decode().rstrip("="):
            raise ValueError(f"a digest of {said} doesn't match its {len(data)} bytes")


def with_referrals(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """(page_id, url, payload binary, digest hex, refers_to): digests are counted, not payloads."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.length("payload").cast("long")})
    # grouped partially before the shuffle; only digests of several pages are joined
    first = rows.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(first, "digest", "left")
    refers = F.when((F.col("size") >= min_revisit) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_warc(pages: DataFrame, out: str, min_revisit: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write ``part-*.warc.gz`` below ``out``, an archive per task; returns the manifest (file, records, bytes).

    Files have names of their own and only those in the manifest count, so a lost attempt leaves
    at most an unused file.
    """

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, folder = file_system(out)
        fs.create_dir(folder, recursive=True)
        name, n, size, sink = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for rows in arrow_rows(batch, "page_id", "url", "payload", "refers_to", at_once=64):
                sink = sink or fs.open_output_stream(f"{folder}/{name}", compression=None)
                for page_id, url, payload, refers_to in zip(*rows, strict=True):
                    record = page_record(page_id, url, payload, sha1_base32(payload), refers_to, date, level)
                    sink.write(record)
                    n, size = n + 1, size + len(record)
        if sink:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["file", "records", "bytes"])

    return materialize(with_referrals(pages, min_revisit).mapInArrow(write, "file string, records long, bytes long"), "warc-manifest")


def read_warc(manifest: DataFrame, out: str, with_payload: bool = True) -> DataFrame:
    """Read archives front to back, one task for each: (page_id, url, record_type, payload_digest, payload_bytes, refers_to, record_id[, payload]).

    ``manifest`` has a column ``file``, archives of any maker below ``out``. Every record is framed and verified, but only responses, revisits and
    resources are returned; ids that aren't ours (``<urn:page:N>``) stand in record_id alone, and page_id and refers_to are null. A digest
    that isn't given is null; one of another algorithm than SHA-1 stands with its name.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, folder = file_system(out)
        page = lambda x: int(m[1]) if (m := OWN_ID.fullmatch(x or "")) else None
        digest = lambda x: x and (x[5:] if x.lower().startswith("sha1:") else x)
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_payload
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "record_id"] + ["payload"] * with_payload
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{folder}/{file}", compression=None) as stream:
                    for head, http, payload in WarcReader(stream):
                        if head.get("warc-type") not in RETURNED:
                            continue
                        size = int(http.get("content-length", len(payload)) if head["warc-type"] == "revisit" else len(payload))
                        rows.append((page(head.get("warc-record-id")), head.get("warc-target-uri"), head["warc-type"], digest(head.get("warc-payload-digest")), size, page(head.get("warc-refers-to")), head.get("warc-record-id")) + (payload,) * with_payload)
                        held += len(payload) * with_payload
                        if len(rows) == 1000 or held > READ << 6:
                            yield flush(rows)
                            rows, held = [], 0
                if rows:
                    yield flush(rows)

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, record_id string" + ", payload binary" * with_payload
    # the manifest is tiny, so its own partitions would follow its size and not the work
    numbered = manifest.select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("task"))
    return numbered.repartitionById(max(1, manifest.count()), "task").select("file").mapInArrow(read, schema)
