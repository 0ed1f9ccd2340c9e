"""A content-addressed web archive.

``payloads`` holds the bytes of each distinct payload once, under their SHA-256; ``records`` holds for each capture the exact
WARC/1.1 header block (and nothing of the payload), with the digest it points to. Payloads are read once, verified against their
digests and joined to the responses; a revisit is joined to the verified lengths and digests alone, so that the bytes of a payload
with millions of captures are read once. ``restore_pages`` joins them to every record. Of captures with the same payload the one
with the smallest id is a ``response``; others are ``revisit`` records that refer to it.

Hashes are computed where the rows are read. Captures are compared by (digest, id) alone, so payload bytes move once only, in
the join that reads the archive.

Defined results: a null html is the empty payload. Rows that tie for the smallest id of a payload are all responses. A row with
a null id is a revisit unless no row of its payload has an id; its record id is that of the empty text. A null url gives an
empty target. Payloads shorter than ``least`` bytes are always responses. A payload of any length is one value. Columns but
page_id, url and html don't enter the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches

_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Captures without bytes of their own that are broadcast, at about a hundred bytes each.
MOST_BROADCAST = 200_000
#: Given to every record, so that an archive of the same pages is the same.
DATE = "2024-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    payloads: DataFrame  # digest, payload
    records: DataFrame  # page_id, digest, header


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, 'page:' + ('' if page_id is None else str(page_id)))}>"


def _header(page_id, url, kind, refers_to, sha1, length) -> bytes:
    """The header block up to and with its empty line."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{sha1}")]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", str(refers_to)), ("X-Payload-Length", str(length))]
    fields += [("X-Page", "" if page_id is None else str(page_id)), ("Content-Type", "text/html"), ("Content-Length", str(0 if kind == "revisit" else length))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _payload() -> Column:
    return F.encode(F.coalesce("html", F.lit("")), "UTF-8")


def write_archive(pages: DataFrame, scratch: Scratch, least: int = 0) -> Archive:
    """Write the archive of ``pages`` (page_id, url, html) under the shared folder."""
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), "url", _payload().alias("payload"))
    plain = rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("length"))
    index = scratch.save(plain, "index")
    first = index.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("captures")).where("captures > 1").drop("captures")
    revisit = (F.col("length") >= least) & F.col("captures_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("captures_first"))
    typed = index.join(first.withColumnRenamed("first", "captures_first"), "digest", "left").select("*", F.when(revisit, "revisit").otherwise("response").alias("kind"))
    records = typed.select("page_id", "url", "digest", "kind", F.when(revisit, F.col("captures_first")).alias("refers_to"), "sha1", "length")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            page, url, digest, kind, refers, sha1, length = (c.to_pylist() for c in b.columns)
            sha32 = [base64.b32encode(bytes.fromhex(x)).decode() for x in sha1]
            headers = [_header(*x) for x in zip(page, url, kind, refers, sha32, length, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(headers, pa.binary())], names=["page_id", "digest", "header"])

    written = scratch.save(records.mapInArrow(head, "page_id long, digest string, header binary"), "records")
    # one capture of each payload brings its bytes; the others are left out by a list of them if that is short, else by a join
    others = index.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("other"), F.col("digest").alias("same"))
    others = scratch.save(others, "others")
    if others.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        others = F.broadcast(others)
    bytes_of = rows.select("page_id", F.sha2("payload", 256).alias("digest"), "payload")
    once = bytes_of.join(others, (bytes_of["digest"] == F.col("same")) & bytes_of["page_id"].eqNullSafe(F.col("other")), "left_anti").select("digest", "payload")
    ties = index.groupBy("digest", "page_id").count().where("count > 1")
    if not ties.isEmpty():
        once = once.groupBy("digest").agg(F.min("payload").alias("payload"))
    return Archive(scratch.save(once, "payloads"), written)


_CHECKED = "digest string, sha1 string, length long"
_READ = "page_id long, record_type string, refers_to long, target string, payload_digest string, payload_bytes long, record binary"


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-1 and length of payloads whose SHA-256 is their digest; another one stops the job."""
    for b in batches:
        out = []
        for digest, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload {digest} is damaged")
            out.append((digest, base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["digest", "sha1", "length"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fields of header blocks, held against what their payloads were found to be."""
    for b in batches:
        out = []
        for header, sha32, found, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
            head, end, rest = header.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not end or rest or lines[0] != "WARC/1.1":
                raise ValueError("damaged header block")
            field = dict(x.split(": ", 1) for x in lines[1:])
            kind = field["WARC-Type"]
            length = int(field["X-Payload-Length" if kind == "revisit" else "Content-Length"])
            if sha32 is None or field["WARC-Payload-Digest"] != f"sha1:{sha32}" or length != found:
                raise ValueError(f"{field['WARC-Record-ID']}: its payload is missing or damaged")
            page, refers = field["X-Page"], field.get("X-Refers-To-Page")
            block = b"" if kind == "revisit" else payload
            out.append((int(page) if page else None, kind, int(refers) if refers not in (None, "None") else None, field["WARC-Target-URI"], sha32, length, header + block + b"\r\n\r\n"))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "record_type", "refers_to", "target", "payload_digest", "payload_bytes", "record"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)


def read_archive(archive: Archive) -> DataFrame:
    """(page_id, record_type, refers_to, target, payload_digest, payload_bytes, record) of every record.

    ``record`` is the WARC record as bytes: header block, block and end. A payload whose SHA-256, SHA-1 or length isn't what the
    stores say, or that is missing, stops the job.
    """
    revisit = F.col("header").startswith(F.lit("WARC/1.1\r\nWARC-Type: revisit\r\n").cast("binary"))
    checked = archive.payloads.select("digest", "payload").mapInArrow(_checked, _CHECKED)
    # a digest with very many revisits is one key: AQE splits its partition, whose other side is a row a digest
    revisits = archive.records.where(revisit).join(checked, "digest", "left").select("header", "sha1", "length", F.lit(None).cast("binary").alias("payload"))
    both = archive.records.where(~revisit).select("header", "digest").join(archive.payloads, "digest", "left")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha, size = [], []
            for digest, payload in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if payload is None or hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload {digest} is missing or damaged")
                sha.append(base64.b32encode(hashlib.sha1(payload).digest()).decode())
                size.append(len(payload))
            whole = pa.RecordBatch.from_arrays([b.column(0), pa.array(sha, pa.string()), pa.array(size, pa.int64()), b.column(2)], names=["header", "sha1", "length", "payload"])
            yield from _parsed(iter([whole]))

    return both.select("header", "digest", "payload").mapInArrow(hashed, _READ).union(revisits.mapInArrow(_parsed, _READ))


def restore_pages(archive: Archive) -> DataFrame:
    """(page_id, target, html) of every capture, the bytes of revisits joined from their payload."""
    records = archive.records.select("page_id", "digest", "header").join(archive.payloads, "digest", "left")
    target = F.regexp_extract(F.decode("header", "UTF-8"), "WARC-Target-URI: ([^\r]*)\r\n", 1)
    return records.select("page_id", target.alias("target"), F.decode("payload", "UTF-8").alias("html"))
