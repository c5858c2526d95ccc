"""WARC archives in which equal payloads are stored once: revisit resolution.

Writing. The headers of all records (payload digest, page id, url) are shuffled by payload digest, and the first of each
group of equal payloads is its original. Records meet the originals by digest: an original and a payload
that no other record has are written as responses, the others as revisit records, which hold headers alone. Only
digests that more than one record has are in the table of originals; Spark broadcasts it while it is small by
its files' size, so payloads do not move, and beyond that joins by shuffle, where it can split a hot digest.
Every record gets fresh headers: record id, date, digests, lengths and HTTP head.

Archives are plain WARC/1.1 files, written by Spark's own writer so that they can be in any store Spark
reaches: its lines are packs of whole records less the last newline, which ends every record. A file begins with
a warcinfo record and holds FILE_PACKS packs of about PACK_BYTES, or one longer record, so no file grows with the table.

Reading. Files are parsed record by record, payload digests are made anew and compared, and revisit records meet
the responses that they refer to by digest and record id.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, save

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
PACK_BYTES, FILE_PACKS = 1 << 20, 32
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, record_id string, refers_record string, payload_digest string, payload_bytes long"
_END = b"\r\n\r\n"


def record_id(*named: object) -> str:
    """A record's URN, a UUID made of what names it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(named).encode()).digest()[:16], version=5)}>"


def safe_uri(url: str) -> str:
    """The url with white space and control characters escaped, so that it stays one header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def make_record(kind: str, name: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record; fields without a value are left out."""
    named = [("WARC-Type", kind), ("WARC-Record-ID", name), *fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in named if v is not None)
    return f"{VERSION}\r\n{head}\r\n".encode() + block + _END


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _packs(date: str):
    """(page_id, url, html as bytes, digest, n_bytes, original, revisit, first_id, first_url) to packs of records less
    their last newline. `original` is whether others refer to the record; a revisit (html null) refers to the first id and url."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ordinal, packs = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        size = 0

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, html, digest, n_bytes, original, revisit, first_id, first_url = (c[k].as_py() for c in batch.columns)
                if not held and packs % FILE_PACKS == 0:
                    about = b"format: WARC File Format 1.1\r\nsoftware: tessera\r\n"
                    info = record_id("warcinfo", date, task, packs // FILE_PACKS)
                    held.append(make_record("warcinfo", info, [("WARC-Date", date), ("Content-Type", "application/warc-fields")], about))
                name = record_id(page_id, url, digest) if original else record_id(page_id, url, digest, date, task, ordinal)
                fields = [("WARC-Date", date), ("WARC-Target-URI", url and safe_uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-ID", page_id)]
                fields.append(("Content-Type", "application/http; msgtype=response"))
                if revisit:
                    fields += [
                        ("WARC-Profile", REVISIT_PROFILE),
                        ("WARC-Refers-To", record_id(first_id, first_url, digest)),
                        ("WARC-Refers-To-Target-URI", first_url and safe_uri(first_url)),
                        ("WARC-Refers-To-Date", date),
                    ]
                    record = make_record("revisit", name, fields, http_head(n_bytes))
                else:
                    record = make_record("response", name, fields, http_head(n_bytes) + html)
                held.append(record)
                size, ordinal = size + len(record), ordinal + 1
                if size >= PACK_BYTES:
                    yield pack()
                    held.clear()
                    size, packs = 0, packs + 1
        if held:
            yield pack()

    return run


def write_archives(pages: DataFrame, path: str, date: str | None = None, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each row of pages(page_id, url, html) into WARC files under path.

    Of records with equal payloads of at least `least_bytes` that with the smallest page_id (null last, then the
    smallest url, null last) is the response, the others are revisits; of rows equal in all of it one is. A null html is an
    empty payload. `date` is the records' date, now if not given.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("n_bytes", F.octet_length("html").cast("long"))
    heads = rows.filter(F.col("n_bytes") >= least_bytes).groupBy("digest", "page_id", "url").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url", "copies")
    firsts = heads.groupBy("digest").agg(F.min(order).alias("first"), F.sum("copies").alias("n")).filter(F.col("n") > 1)
    firsts = firsts.select(F.col("digest").alias("of_digest"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first.copies").alias("copies"))
    firsts = save(firsts, "originals")

    is_first = F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    met = rows.join(firsts, (F.col("digest") == F.col("of_digest")) & (F.col("n_bytes") >= least_bytes), "left")
    many = F.col("of_digest").isNotNull()
    columns = ["page_id", "url", "html", "digest", "n_bytes", "original", "revisit", "first_id", "first_url"]
    once = met.filter(~many | ~is_first | (F.col("copies") == 1)).withColumn("original", many & is_first).withColumn("revisit", many & ~is_first)
    once = once.withColumn("html", F.when(~F.col("revisit"), F.col("html"))).select(columns)
    # rows equal to the original in id, url and payload: one response, and a revisit for each further copy
    ties = firsts.filter(F.col("copies") > 1)
    if not ties.isEmpty():
        same = rows.join(ties, F.col("digest") == F.col("of_digest")).filter(is_first)
        one = same.groupBy("digest", "page_id", "url", "n_bytes", "first_id", "first_url", "copies").agg(F.first("html").alias("html"))
        one = one.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        one = one.withColumn("original", F.col("copy") == 0).withColumn("revisit", F.col("copy") > 0)
        once = once.unionByName(one.withColumn("html", F.when(F.col("original"), F.col("html"))).select(columns))
    lines = once.withColumn("html", F.col("html").cast("binary")).mapInArrow(_packs(date), "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("compression", "none").option("maxRecordsPerFile", FILE_PACKS).text(path)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive, plain or gzipped."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    view, at = memoryview(content), 0
    while at < len(content):
        end = content.find(_END, at)
        if end < 0 or content[at : at + 5] != b"WARC/":
            raise ValueError(f"not a WARC record at byte {at}")
        lines = content[at:end].decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin, length = end + 4, int(head["content-length"])
        if bytes(view[begin + length : begin + length + 4]) != _END:
            raise ValueError(f"a WARC record that is cut short at byte {at}")
        yield head, bytes(view[begin : begin + length])
        at = begin + length + 4


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """File contents to RECORD, warcinfo left out; a payload that its digest does not fit is an error."""
    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64()]
    names = ["page_id", "url", "record_type", "record_id", "refers_record", "payload_digest", "payload_bytes"]
    for batch in batches:
        for content in batch.column(0):
            found = []
            for head, block in parse(content.as_py()):
                if head["warc-type"] not in ("response", "revisit"):
                    continue
                digest, n_bytes = head["warc-payload-digest"].partition(":")[2], None
                if head["warc-type"] == "response":
                    payload = block[block.index(_END) + 4 :]
                    n_bytes, made = len(payload), hashlib.sha256(payload).hexdigest()
                    if made != digest:
                        raise ValueError(f"record {head['warc-record-id']}: its payload has another digest")
                page_id = int(head["page-id"]) if "page-id" in head else None
                found.append((page_id, head.get("warc-target-uri"), head["warc-type"], head["warc-record-id"], head.get("warc-refers-to"), digest, n_bytes))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """RECORD of each response and revisit record of the archives under path, headers alone: payloads are read and
    checked where they lie, and payload_bytes of a revisit is null."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").filter(F.length("content") > 0).mapInArrow(_records, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """RECORD with refers_to, the page_id of the response that a revisit refers to, and with its payload_bytes.

    Headers are shuffled by payload digest; revisits meet the responses of that digest and record id. A revisit whose
    response is not there keeps null in both.
    """
    responses = records.filter(F.col("record_type") == "response")
    heads = responses.select(F.col("payload_digest").alias("of_digest"), F.col("record_id").alias("of_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("of_bytes"))
    revisits = records.filter(F.col("record_type") == "revisit")
    met = revisits.join(heads, (F.col("payload_digest") == F.col("of_digest")) & (F.col("refers_record") == F.col("of_record")), "left")
    met = met.withColumn("payload_bytes", F.col("of_bytes")).drop("of_digest", "of_record", "of_bytes")
    return responses.withColumn("refers_to", F.lit(None).cast("long")).unionByName(met)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, from archives that are
    written in the shared folder and read back.

    Null html: an empty payload, a response. Payloads under LEAST_BYTES are all responses. Rows that repeat an id have a
    record each; of rows equal in payload, id and url one is the response, and the others refer to their own id. A null
    page_id comes after all others. Only page_id, url and html are read. Empty table: empty result.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    records = save(read_archives(spark, path), "records")
    return resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM (
  SELECT *, n >= 100 AND nth > 1 AS again FROM (
    SELECT page_id, n, d, row_number() OVER (PARTITION BY d ORDER BY page_id, url) AS nth, first_value(page_id) OVER (PARTITION BY d ORDER BY page_id, url) AS first_id
    FROM (SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages)
  )
)
"""
