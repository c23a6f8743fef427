"""WARC archives: written with one gzip member per record, read record by record in one pass.

Writing: copies of a payload become revisit records that name the response holding it. A task collects records to archives of about
``ARCHIVE_BYTES``; Spark's text writer puts each into a file of its own, on any file system it knows, and its commit
keeps files of failed or repeated tasks out. The writer ends each file with a line separator of the caller's choice: here a last gzip
member with a ``warcinfo`` record that closes the archive.

Reading: bytes are inflated piece by piece as far as a record's head and then its content length ask, so a reader holds one record; at
the end of a member the next begins. Block and payload digests are computed along the way and compared with those of the head.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.llm.common import join_counted
from skysift.session import fresh_folder, staged

#: Compressed bytes after which an archive is closed; a record is never cut.
ARCHIVE_BYTES = 8 << 20
PIECE = 1 << 16
#: Payloads below this are written again rather than referred to.
LEAST_SHARED = 1_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = "WARC/1.1"
_GZIP = 16 + zlib.MAX_WBITS
READ_SCHEMA = (
    "archive string, offset long, type string, record_id string, target_uri string, date string, refers_to string, payload_digest string,"
    " payload_bytes long, payload binary, intact boolean"
)


class BadArchive(ValueError):
    """Bytes that are no sequence of gzip members with one record each."""


# --- writing ----------------------------------------------------------------------------


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: blanks and control characters are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member of its own, the same for the same record."""
    lines = [VERSION, *(f"{name}: {value}" for name, value in headers), f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_member(record_id: str, uri: str | None, payload: bytes, payload_digest: str, length: int, refers_to: str | None, date: str = DATE) -> bytes:
    """A response with its payload, or the revisit of the record ``refers_to``, which holds it."""
    kind = "response" if refers_to is None else "revisit"
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", _clean(uri) if uri else record_id), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", payload_digest),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    return member(headers, _http_head(length) + (payload if refers_to is None else b""))


def closing_member(name: str, date: str = DATE) -> bytes:
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
    return member(headers, b"format: WARC File Format 1.1\r\n")


def _packed(limit: int, date: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c) for c in ("record_id", "uri", "payload", "digest", "length", "refers_to")]
            for row in range(len(batch)):
                record_id, uri, payload, digest, length, refers_to = (c[row].as_py() for c in columns)
                digest = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
                held.append(page_member(record_id, uri, payload or b"", digest, length, refers_to, date))
                size += len(held[-1])
                if size >= limit:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    return pack


def planned(pages: DataFrame, key: str = "page_id", uri: str = "url", text: str = "html", namespace: str = "page") -> DataFrame:
    """Records to write: (record_id, uri, payload, digest, length, refers_to), one per row.

    Of the rows whose payloads are equal (by SHA-1 and length) and have ``LEAST_SHARED`` bytes or more, the one with the largest
    key is the response and the others refer to it; a null key is the smallest, of equal keys one row wins. A null text is an
    empty payload. Record ids name key and row, so that repeated keys make records of their own.
    """
    payload = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("key"), F.col(key).alias("order"),
        F.col(uri).cast("string").alias("uri"), payload.alias("payload"),
    )
    rows = staged(rows.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload").cast("long")}), "payloads")
    shared = rows.filter(F.col("length") >= LEAST_SHARED).select(
        "row", "order", F.concat_ws("-", "digest", F.col("length").cast("string")).alias("same")
    )
    # Two numbers decide; the key's text follows from the row that wins.
    holders = shared.groupBy("same").agg(
        F.max(F.struct("order", "row")).alias("first"), F.count(F.lit(1)).alias("copies")
    ).filter("copies > 1").select("same", "copies", F.col("first.order").cast("string").alias("first_key"), F.col("first.row").alias("first_row"))
    name = lambda k, r: F.concat(F.lit(f"urn:{namespace}:"), F.coalesce(F.col(k), F.lit("")), F.lit(":"), F.col(r).cast("string"))
    seen = join_counted(staged(shared.select("row", "same"), "shared"), staged(holders, "holders"), "same", "copies")
    revisits = staged(seen.filter("first_row is not null and first_row <> row").select("row", name("first_key", "first_row").alias("refers_to")), "revisits")
    # Payloads meet their decision by row number: evenly, however many copies a payload has.
    full = rows.join(revisits, "row", "left")
    body = F.when(F.col("refers_to").isNull(), F.col("payload"))
    return full.select(name("key", "row").alias("record_id"), "uri", body.alias("payload"), "digest", "length", "refers_to")


def write(records: DataFrame, path: str, limit: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    """Write planned records to archives of about ``limit`` bytes below ``path``; an empty table makes no record."""
    blocks = records.mapInArrow(_packed(limit, date), "archive binary").select(F.col("archive").cast("string").alias("value"))
    closing = closing_member(str(uuid.uuid4()), date).decode("latin-1")
    # Latin-1 makes the separator exactly these bytes; archives are passed through as they are.
    blocks.write.option("lineSep", closing).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).option("compression", "none").text(path)


# --- reading ----------------------------------------------------------------------------


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes
    intact: bool = True
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    @property
    def type(self) -> str:
        return self.headers.get("warc-type", "")


class _Source:
    """Compressed bytes from an iterator of pieces, inflated one gzip member at a time."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.ahead, self.read = iter(pieces), b"", 0

    def more(self) -> bool:
        while not self.ahead:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.ahead = piece
        return True

    def open(self) -> None:
        self.inflate, self.plain = zlib.decompressobj(_GZIP), bytearray()

    def fill(self) -> bool:
        """Inflate some more of the member; false at its end."""
        if self.inflate.eof:
            return False
        self.more()
        given, before = self.ahead, len(self.plain)
        try:
            self.plain += self.inflate.decompress(given, PIECE)
        except zlib.error as error:
            raise BadArchive(f"no gzip data at byte {self.read}: {error}") from error
        self.ahead = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        self.read += len(given) - len(self.ahead)
        if not given and not self.inflate.eof and len(self.plain) == before:
            raise BadArchive(f"cut off at byte {self.read}")
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.plain.find(mark, start)) < 0:
            start = max(0, len(self.plain) - len(mark) + 1)
            if not self.fill():
                raise BadArchive(f"no end of a head before byte {self.read}")
        out = bytes(self.plain[:at])
        del self.plain[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self.fill():
                raise BadArchive(f"content shorter than its length before byte {self.read}")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out


def _fields(lines: list[str]) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def _same_digest(stated: str | None, data: bytes) -> bool:
    """Whether data has the stated digest; true without one, or with one of another algorithm."""
    if not stated or not stated.lower().startswith("sha1:"):
        return True
    value, found = stated[5:], hashlib.sha1(data).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def records(pieces: Iterable[bytes]) -> Iterator[Record]:
    """All records of an archive given piece by piece, in order."""
    source = _Source(pieces)
    while source.more():
        offset = source.read
        source.open()
        head = source.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise BadArchive(f"no record at byte {offset}")
        headers = _fields(head[1:])
        length = headers.get("content-length", "")
        if not length.isdigit():
            raise BadArchive(f"no content length at byte {offset}")
        block = source.exactly(int(length))
        if source.exactly(4) != b"\r\n\r\n":
            raise BadArchive(f"content longer than its length at byte {offset}")
        while source.fill():
            pass
        if source.plain:
            raise BadArchive(f"more than one record in the member at byte {offset}")
        record = Record(offset, headers, block, _same_digest(headers.get("warc-block-digest"), block))
        if headers.get("content-type", "").startswith("application/http"):
            http_head, _, record.payload = block.partition(b"\r\n\r\n")
            record.http = _fields(http_head.decode("latin-1").split("\r\n")[1:])
            if record.type == "response":
                record.intact = record.intact and _same_digest(headers.get("warc-payload-digest"), record.payload)
        yield record


def _bare(value: str | None) -> str | None:
    return value.strip("<>") if value else None


def _hex(stated: str | None) -> str | None:
    if not stated or ":" not in stated:
        return None
    value = stated.split(":", 1)[1]
    return value.lower() if len(value) == 40 else base64.b32decode(value).hex()


def _row(archive: str, r: Record, payloads: bool) -> dict:
    full = r.http.get("content-length", "") if r.type == "revisit" else str(len(r.payload))
    return {
        "archive": archive, "offset": r.offset, "type": r.type, "record_id": _bare(r.headers.get("warc-record-id")),
        "target_uri": r.headers.get("warc-target-uri"), "date": r.headers.get("warc-date"), "refers_to": _bare(r.headers.get("warc-refers-to")),
        "payload_digest": _hex(r.headers.get("warc-payload-digest")), "payload_bytes": int(full) if full.isdigit() else None,
        "payload": r.payload if payloads else None, "intact": r.intact,
    }


def _read_batches(payloads: bool):
    schema = pa.schema(
        [(n, pa.string()) for n in ("archive",)] + [("offset", pa.int64())]
        + [(n, pa.string()) for n in ("type", "record_id", "target_uri", "date", "refers_to", "payload_digest")]
        + [("payload_bytes", pa.int64()), ("payload", pa.binary()), ("intact", pa.bool_())]
    )

    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                body, held, size = memoryview(content.as_buffer()), [], 0
                for record in records(bytes(body[at : at + PIECE]) for at in range(0, len(body), PIECE)):
                    held.append(_row(name.as_py(), record, payloads))
                    size += len(record.block)
                    if size >= ARCHIVE_BYTES or len(held) >= 10_000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return read_all


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives below a path, one row each, in the columns of ``READ_SCHEMA``.

    An archive is read by one task from its first byte to its last and is held there once (Spark's limit: 2 GB); bytes that are no
    archive raise ``BadArchive``. ``payload_bytes`` of a revisit is the length its HTTP head states; ``intact`` says whether block
    and payload have the digests their head states. Without ``payloads`` these are checked but not returned.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read_batches(payloads), READ_SCHEMA)


def key_of(record_id: Column, namespace: str = "page") -> Column:
    """The key's text in a record id made by ``planned``; null for a null key."""
    return F.nullif(F.regexp_extract(record_id, f"^urn:{namespace}:(.*):[0-9]+$", 1), F.lit(""))


def archived(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", text: str = "html") -> DataFrame:
    """Write the pages to archives below ``path``, read these back, and say per page what its record holds.

    Returns key, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` (a key) and ``intact``. Nulls, empty and very long texts
    are pages like others; repeated rows are records each; an empty table gives no rows. Other columns are not read.
    """
    write(planned(pages, key, uri, text), path)
    kind = pages.schema[key].dataType
    found = read(pages.sparkSession, path, payloads=False).filter(F.col("type") != "warcinfo")
    return found.select(
        key_of(F.col("record_id")).cast(kind).alias(key), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        key_of(F.col("refers_to")).cast(kind).alias("refers_to"), "intact",
    )


def archive_folder(spark: SparkSession) -> str:
    return fresh_folder(spark, "archives")
