"""WARC archives: one gzip member per record, and a sequential reader.

The writer packs records into archives of bounded size, each a row (archive, content) of a table in the shared folder, so
that any store Spark can write to will do; files read with Spark's binaryFile source have the same `content` column. Every
row is made a gzip member where it is read, and members, not payloads, are what is shuffled to meet the flags.

The reader takes an archive from its start to its end: it inflates one gzip member at a time in small steps, reads the header
as soon as it is there, takes as many payload bytes as Content-Length says as they arrive, and recomputes the payload digest
on the way. Where a member is broken or cut off, what is known of its record is a row with intact = false, and reading goes on
at the next member.

A payload equal to an earlier one (by SHA-1 and length) is written as a revisit record that has only the header and names
the record it refers to. A null payload is the empty payload; a null key is record "None", a response, and is null again in op4_warc, as is any
id that is no number. Rows that repeat the first row's
key are responses too, other rows of one payload revisit the smallest key; rows that repeat a key with other payloads are
records of their own. Equal payloads may be any share of all rows: the first of each is found by a pre-aggregated minimum, no
group of equal payloads is ever collected, and Spark may split its join. An empty table makes no archive. Columns other than
the three that are named are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm._common import stored, table

#: Bytes of compressed records in one archive row, about.
ARCHIVE_BYTES = 8 << 20
STEP = 64 << 10
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes
    length: int  # of the payload, kept or not
    intact: bool


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(headers: dict[str, str], payload: bytes, level: int = 4) -> bytes:
    head = "".join([f"{VERSION}\r\n", *[f"{k}: {v}\r\n" for k, v in headers.items()], f"Content-Length: {len(payload)}\r\n\r\n"])
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(payload) + packer.compress(b"\r\n\r\n") + packer.flush()


MAGIC = b"\x1f\x8b\x08"


class _Framer:
    """One record out of pieces of an inflated member: the header, then Content-Length bytes of payload, then two line ends."""

    def __init__(self, keep: bool):
        self.keep, self.head, self.headers, self.left = keep, b"", None, 0
        self.sha1, self.taken, self.parts, self.tail = hashlib.sha1(), 0, [], b""

    def add(self, piece: bytes) -> None:
        if self.headers is None:
            head, found, piece = (self.head + piece).partition(b"\r\n\r\n")
            if not found:
                self.head = head
                return
            first, *lines = head.decode("utf-8", "replace").split("\r\n")
            self.headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)} if first.startswith("WARC/") else {}
            length = self.headers.get("Content-Length", "")
            self.left = int(length) if length.isdecimal() else -1
        payload = piece[: max(self.left, 0)]
        if payload:
            self.left -= len(payload)
            self.taken += len(payload)
            self.sha1.update(payload)
            if self.keep:
                self.parts.append(payload)
        self.tail = (self.tail + piece[len(payload) :])[:5]

    def record(self, ended: bool) -> Record | None:
        """None where the member held no record at all."""
        if not self.headers:
            return None if ended else Record({}, b"", 0, False)
        said = self.headers.get("WARC-Payload-Digest", "").rpartition(":")[2]
        whole = ended and self.left == 0 and self.tail == b"\r\n\r\n"
        right = self.headers.get("WARC-Type") == "revisit" or said == base64.b32encode(self.sha1.digest()).decode()
        return Record(self.headers, b"".join(self.parts), self.taken, whole and right)


def records(content: bytes, keep: bool = True) -> Iterator[Record]:
    """The records of an archive in order, with their payloads if they are to be kept. `intact`: as long as its header says,
    and of the digest that it says."""
    view, at = memoryview(content), 0
    while at < len(view):
        start, member, framer = at, zlib.decompressobj(31), _Framer(keep)
        try:
            while at < len(view) and not member.eof:
                step = view[at : at + STEP]
                framer.add(member.decompress(step))
                at += len(step) - len(member.unused_data)
        except zlib.error:
            pass
        if (found := framer.record(member.eof)) is not None:
            yield found
        if not member.eof:  # the next member begins somewhere behind where this one began
            at = content.find(MAGIC, start + 1)
            if at < 0:
                return


def revisits(slim: DataFrame, key: str, min_bytes: int = 0) -> DataFrame:
    """(key, sha1, payload_bytes, refers_to) of the rows whose payload another row of smaller key has. slim: key, sha1, payload_bytes."""
    first = slim.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1", "payload_bytes").agg(F.min(key).alias("refers_to"), F.count(F.lit(1)).alias("copies"))
    first = stored(first.where("copies > 1").drop("copies"), "first-payloads")
    return slim.join(first, ["sha1", "payload_bytes"]).where(F.col(key) != F.col("refers_to")).distinct()


def write_archives(df: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """(archive, content) rows: one record per row of df."""
    rows = df.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(payload).alias("payload"))
    body = F.coalesce(F.encode("payload", "utf-8"), F.lit(b""))
    seen = {"sha1": F.sha1(body), "payload_bytes": F.octet_length(body).cast("long")}
    flags = revisits(rows.select("key", *[c.alias(n) for n, c in seen.items()]), "key", min_bytes)
    kind = df.schema[key].dataType.simpleString()

    def headers_of(key, url: str | None, digest: str, kind: str) -> dict[str, str]:
        return {"WARC-Type": kind, "WARC-Record-ID": f"<urn:record:{key}>", "WARC-Target-URI": " ".join((url or "").split()), "WARC-Date": DATE, "WARC-Payload-Digest": f"sha1:{digest}"}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "url", "sha1", "payload")]
            made = [member(headers_of(k, u, base64.b32encode(bytes.fromhex(h)).decode(), "response"), (x or "").encode()) for k, u, h, x in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*batch.select(["key", "url", "sha1", "payload_bytes"]).columns, pa.array(made, pa.binary())], names=["key", "url", "sha1", "payload_bytes", "member"])

    members = rows.withColumns(seen).select("key", "url", "sha1", "payload_bytes", "payload").mapInArrow(packed, f"key {kind}, url string, sha1 string, payload_bytes long, member binary")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[bytes] = []
        size, first = 0, None

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"{first}.warc.gz"]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, url, h, length, whole, refers = (batch.column(c)[i].as_py() for c in ("key", "url", "sha1", "payload_bytes", "member", "refers_to"))
                if refers is not None:
                    headers = headers_of(key, url, base64.b32encode(bytes.fromhex(h)).decode(), "revisit")
                    whole = member(headers | {"WARC-Refers-To": f"<urn:record:{refers}>", "WARC-Profile": PROFILE, "X-Payload-Length": str(length)}, b"")
                parts.append(whole)
                size, first = size + len(whole), key if first is None else first
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    parts, size, first = [], 0, None
        if parts:
            yield archive()

    met = members.join(flags, ["key", "sha1", "payload_bytes"], "left")
    return met.select("key", "url", "sha1", "payload_bytes", "member", "refers_to").mapInArrow(archives, "archive string, content binary")


def read_archives(archives: DataFrame, content: str = "content", payloads: bool = True) -> DataFrame:
    """A row per record, of a broken one too (what of its header could not be read is null, intact is false): record_id, record_type, url, refers_to, payload_digest, payload_bytes (both of the full payload,
    which a revisit only names), payload if asked for, and intact."""
    schema = "record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, intact boolean" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for cell in batch.column(content):
                for r in records(cell.as_py() or b"", payloads):
                    h = r.headers
                    named = h.get("X-Payload-Length", "")
                    length = int(named) if h.get("WARC-Type") == "revisit" and named.isdigit() else r.length
                    row = (h.get("WARC-Record-ID"), h.get("WARC-Type"), h.get("WARC-Target-URI"), h.get("WARC-Refers-To"), h.get("WARC-Payload-Digest", "").rpartition(":")[2], length, r.intact)
                    rows.append((*row, r.payload) if payloads else row)
                    held += len(r.payload) * payloads + 300
                    if held > STEP * 64:
                        yield out()
                        rows, held = [], 0
        if rows:
            yield out()

    return archives.select(content).mapInArrow(run, schema)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact of every page, read back from the archives."""
    archives = stored(write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html"), "warc")
    number = lambda c: F.regexp_extract(c, r"<urn:record:(-?\d+)>", 1).try_cast("long")
    return read_archives(archives, payloads=False).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"), "intact"
    )


_GROUP = "CAST('0x' || substr(sha1, CAST(5 * g + 1 AS INT), 5) AS INT)"
ORACLE = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, sha1(html) AS sha1, CAST(strlen(html) AS BIGINT) AS payload_bytes,
                 min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
               lambda s: substr('{BASE32}', (({_GROUP} >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
           CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to, true AS intact
    FROM d"""
