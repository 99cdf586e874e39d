"""WARC archives: writing with revisit records, and a sequential reader.

An archive is a run of gzip members, one for each record. The reader goes through it once with an incremental
decompressor, frames each record by its Content-Length, and verifies the SHA-1 digest of the payload; whatever does
not fit raises, with the archive's name and the record's number.

Of records with equal payloads of at least ``least`` bytes the one with the largest id is the response and the others
revisit it. Equality is that of SHA-256; the digests are counted with partial aggregation and joined back on the
digest, where adaptive execution can split a digest that a large part of all pages has. Shorter pages go past the join.
A row is chosen by its id and URL, not by a number that two scans would have to agree on; only where rows alike in payload, id
and URL compete for the response are those rows written, numbered there, and one is taken.

Executors of a cluster share no local folder, so archives are kept as rows (name, bytes) of a Parquet table in the
shared folder; ``read_files`` reads ordinary ``.warc.gz`` files from wherever Spark's binaryFile source can.

Cases: null payloads are empty; short payloads are all responses; a row repeated whole counts like any other, one
copy being the response; null ids sort below all others; null URLs are left out; empty tables give no archives and
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id string, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to string"


class Record(NamedTuple):
    headers: dict[str, str]
    payload: bytes


def encode(headers: list[tuple[str, str]], payload: bytes, level: int = 4) -> bytes:
    """One record as one gzip member. Header values lose line breaks; Content-Length is added."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}".encode() for k, v in headers), b"Content-Length: %d" % len(payload)]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(lines) + b"\r\n\r\n" + payload + b"\r\n\r\n") + z.flush()


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """Content of each gzip member in turn, inflated ``step`` bytes of input at a time."""
    at, n = 0, len(data)
    while at < n:
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= n:
                raise ValueError("archive ends within a member")
            piece = data[at : at + step]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def records(data: bytes, name: str = "archive") -> Iterator[Record]:
    """Records of an archive in order; ValueError if framing or a digest is wrong."""
    for i, raw in enumerate(members(data)):
        head, mark, body = raw.partition(b"\r\n\r\n")
        first, *lines = head.split(b"\r\n")
        if not mark or not first.startswith(b"WARC/"):
            raise ValueError(f"{name}, record {i}: no WARC header")
        headers = {}
        for line in lines:
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers.get("content-length", -1))
        if size < 0 or body[size:] != b"\r\n\r\n":
            raise ValueError(f"{name}, record {i}: content length does not frame the record")
        payload = body[:size]
        digest = headers.get("warc-payload-digest", "")
        if headers.get("warc-type") != "revisit" and digest.startswith("sha1:") and hashlib.sha1(payload).hexdigest() != digest[5:]:
            raise ValueError(f"{name}, record {i}: payload digest differs")
        yield Record(headers, payload)


def _urn(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(urn: str | None) -> str | None:
    return (urn or "")[len("<urn:page:") : -1] or None


def revisits(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str = "url", least: int = 1000) -> DataFrame:
    """``(page_id, url, payload binary, revisit boolean, refers_to)``, a row for each row of ``pages``."""
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"").cast("binary")).alias("payload"),
    )
    long = F.octet_length("payload") >= least
    keyed = rows.filter(long).withColumn("key", F.sha2("payload", 256))
    alike = keyed.groupBy("key", "page_id", "url").agg(F.count("*").alias("n"))
    best = alike.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("page_id", "url", F.col("n").alias("ties"))).alias("best")).filter("n > 1")
    best = written(best.select("key", F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("best_url"), F.col("best.ties").alias("ties")), "warc-best")
    met = keyed.join(best, "key", "left")
    chosen = F.col("page_id").eqNullSafe(F.col("refers_to")) & F.col("url").eqNullSafe(F.col("best_url"))
    tied = F.coalesce(chosen & (F.col("ties") > 1), F.lit(False))
    out = ["page_id", "url", "payload", "revisit", F.when(F.col("revisit"), F.col("refers_to")).alias("refers_to")]
    single = met.filter(~tied).withColumn("revisit", F.coalesce(~chosen & F.col("ties").isNotNull(), F.lit(False))).select(*out)
    short = rows.filter(~long).select("page_id", "url", "payload", F.lit(False).alias("revisit"), F.lit(None).cast(rows.schema["page_id"].dataType).alias("refers_to"))
    parts = single.union(short)
    if best.filter("ties > 1").isEmpty():
        return parts
    again = written(met.filter(tied).withColumn("row", F.monotonically_increasing_id()), "warc-alike")
    first = again.groupBy("key").agg(F.min("row").alias("first"))
    return parts.union(again.join(first, "key").withColumn("revisit", F.col("row") != F.col("first")).select(*out))


def write_archives(rows: DataFrame, path: str, archive_bytes: int = 2 << 20, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes what ``revisits`` gives as archives of about ``archive_bytes``, into a table (archive, content) at ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for page, url, payload, revisit, refers in zip(*b.columns, strict=True):
                body = payload.as_py() or b""
                headers = [("WARC-Type", "revisit" if revisit.as_py() else "response"), ("WARC-Record-ID", _urn(page.as_py())), ("WARC-Date", date)]
                if url.as_py() is not None:
                    headers.append(("WARC-Target-URI", url.as_py()))
                headers += [("WARC-Payload-Digest", "sha1:" + hashlib.sha1(body).hexdigest()), ("X-Payload-Length", str(len(body))), ("Content-Type", "text/html")]
                if revisit.as_py():
                    headers += [("WARC-Refers-To", _urn(refers.as_py())), ("WARC-Profile", PROFILE)]
                    body = b""
                held.append(encode(headers, body))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], names=["archive", "content"])

    rows.mapInArrow(run, "archive string, content binary").write.mode("overwrite").option("compression", "none").parquet(path)


def parse(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row for each record of ``archives(archive, content)``; with ``payloads`` also the payload (revisits: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(*b.columns, strict=True):
                cols: list[list] = [[] for _ in range(7)]
                for r in records(content.as_py(), name.as_py()):
                    h = r.headers
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or hashlib.sha1(r.payload).hexdigest()
                    row = (_id(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), int(h.get("x-payload-length", len(r.payload))), digest, _id(h.get("warc-refers-to")), r.payload)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: 7 if payloads else 6]
                yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"][: len(arrays)])

    return archives.select("archive", "content").mapInArrow(run, RECORDS + ", payload binary" * payloads)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archives that ``write_archives`` has put at ``path``."""
    return parse(spark.read.schema("archive string, content binary").parquet(path), payloads)


def read_files(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of ordinary ``.warc.gz`` files; each file is one row, so a task holds one file at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return parse(files.select(F.col("path").alias("archive"), "content"), payloads)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: every page to archives and back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = f"{shared_dir(spark)}/marlstone/warc-{uuid.uuid4().hex}"
    write_archives(revisits(pages), path)
    kind = pages.schema["page_id"].dataType
    out = read_archives(spark, path)
    return out.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS d FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS best FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to
FROM m
"""
