"""Operator 8: WARC archives with revisit records for repeated payloads.

Headers (page, payload digest) are shuffled by digest without their payloads;
of the pages with one digest the largest ``page_id`` keeps its payload and the
others become revisit records that refer to it.  Tasks then write gzip-per-record
archives with fresh headers; ``read_archives`` reads every record back and joins
revisits to their responses by record id.

Defined results: a null html is an empty payload; a page of any length is one
record; rows without a ``page_id`` are
responses of their own, never referred to unless no page of that payload has an
id (then each is a response); rows equal in ``page_id`` and payload are all
responses if that page is the response; of several urls of that page the greatest
is the target; a null url is written as an empty target;
an empty table writes no archive; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_by_share, new_dir, read_file, saved, slices, spread, table, write_file

#: Payloads of fewer bytes are always written as responses.
MIN_PAYLOAD_BYTES = 0
ARCHIVE_BYTES = 16_000_000
#: Tasks that share the headers of one payload.
SALTS = 16
#: Compressed bytes that the reader unpacks at a time.
READ_BYTES = 8192
#: The date of every record: archives of the same pages are the same bytes.
RECORD_DATE = "2024-01-01T00:00:00Z"
_SPACE_OF_IDS = uuid.UUID("5d0c7c1e-3c39-4c56-8f5f-1f0a6f1b9b5e")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_OF_IDS, f'{page_id}/{digest}')}>"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, target: str | None) -> bytes:
    digest = payload_digest(payload)
    revisit = refers_to is not None
    body = _HTTP if revisit else _HTTP + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": RECORD_DATE,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{payload_digest(body)}",
        "Content-Type": "application/http; msgtype=response",
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if revisit:
        head |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": record_id(refers_to, digest),
            "WARC-Refers-To-Target-URI": " ".join((target or "").split()),
            "WARC-Refers-To-Date": RECORD_DATE,
        }
    head["Content-Length"] = str(len(body))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8") + b"\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def resolve(pages: DataFrame, min_payload_bytes: int = MIN_PAYLOAD_BYTES) -> DataFrame:
    """(page_id, digest) of every page that revisits another, with ``refers_to`` and ``target``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    headers = pages.select("page_id", "url", F.sha1(payload).alias("digest"), F.length(payload).alias("n")).where((F.col("n") >= min_payload_bytes) & F.col("page_id").isNotNull())
    # Of rows with the largest page_id, the greatest url stands for the target.
    first = headers.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("r"), F.min("page_id").alias("_low")).where(F.col("_low") < F.col("r.page_id"))
    # A payload may belong to a third of all pages: its headers are dealt to SALTS tasks.
    first = first.select("digest", F.col("r.page_id").alias("refers_to"), F.col("r.url").alias("target"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = headers.select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    found = salted.join(first, ["digest", "_salt"]).where(F.col("page_id") < F.col("refers_to"))
    return found.select("page_id", "digest", "refers_to", "target").distinct()


def write_archives(pages: DataFrame, path: str, min_payload_bytes: int = MIN_PAYLOAD_BYTES) -> DataFrame:
    """Writes deduplicated archives under ``path``; returns their manifest (path, n_records).

    A task that runs twice writes other file names; only files in the manifest count.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    revisits = resolve(pages, min_payload_bytes).withColumnsRenamed({"page_id": "_page", "digest": "_digest"})
    joined = keyed.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "refers_to", "target")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, records = io.BytesIO(), 0

        def flush() -> pa.RecordBatch:
            nonlocal out, records
            name = f"{path}/pages-{uuid.uuid4().hex}.warc.gz"
            write_file(name, out.getvalue())
            row = pa.RecordBatch.from_pydict({"path": [name], "n_records": [records]})
            out, records = io.BytesIO(), 0
            return row

        for batch in slices(batches):
            for page_id, url, html, refers_to, target in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                out.write(_record(page_id, url, html.encode("utf-8"), refers_to, target))
                records += 1
                if out.tell() >= ARCHIVE_BYTES:
                    yield flush()
        if records:
            yield flush()

    return saved(joined.mapInArrow(write, "path string, n_records long"), "op8-manifest")


def iter_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of a gzip-per-record archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            part = view[at : at + READ_BYTES]
            parts.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record, revisits with the page and payload length of their response."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for headers, block in iter_records(read_file(path)):
                    payload = block.partition(b"\r\n\r\n")[2]
                    page, revisit = headers.get("X-Page-ID"), headers["WARC-Type"] == "revisit"
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and payload_digest(payload) != digest:
                        raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {path}")
                    rows.append((page and int(page), None if revisit else len(payload), digest, headers["WARC-Type"], headers["WARC-Record-ID"], headers.get("WARC-Refers-To")))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id"]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string"
    records = saved(spread(manifest.select("path"), "path").mapInArrow(read, schema), "op8-records")
    responses = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").withColumn("_target", F.col("refers_to_id").cast("binary"))
    wanted = revisits.groupBy(F.col("refers_to_id").alias("_id")).agg(F.count("*").alias("_held"))
    # One row a response, though equal rows may have written equal records; a response that many revisit is broadcast.
    originals = responses.join(wanted, F.col("record_id") == F.col("_id")).groupBy(F.col("record_id").cast("binary").alias("_target")).agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("_bytes"), F.max("_held").alias("_held"))
    revisits = joined_by_share(revisits, originals, "_target", "_held", revisits.count())
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.withColumnRenamed("_bytes", "payload_bytes").select(*columns))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"), new_dir(spark, "op8-archives")))


# Base32 by groups of five hexadecimal digits, that is of four letters.
SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), d AS (
  SELECT page_id, octet_length(body) AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest FROM p
), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM r
"""
