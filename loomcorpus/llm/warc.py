"""WARC archives: writing captures, reading them back, assembling transactions.

A capture is three records: request, response (or revisit of an equal payload) and metadata; request
and metadata name the main record in WARC-Concurrent-To.  Archives are written by Spark's text writer,
whose line separator is the blank line that ends a WARC record: any file system, and its commit
protocol, so a lost executor leaves no half file.  Reading parses by Content-Length, so a payload may
hold anything.  Transactions are joined through the identifiers, and come out as one nested row each;
a revisit's row holds the response that its WARC-Refers-To names, found among the records read.

Defined cases: a null html is an empty payload; a null url is an empty target; a null page_id is a
capture without a number; payloads under `min_revisit` bytes are never revisits; rows that share
page_id and payload share their identifiers and come out as captures each; of equal payloads all rows
with the smallest page_id are responses; captures without a page_id are responses; a revisit whose
response isn't there has null in its place; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomcorpus.llm.common import dealt_join, discard, shared_dir, written

MIN_REVISIT = 100
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Records of a file at most: a file is parsed in one piece.
FILE_RECORDS = 1000
#: Revisits whose keys are broadcast at most, of 72 bytes each; with more, the pages are shuffled.
BROADCAST_ROWS = 200_000
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, "
    "payload_digest string, page_id long, payload binary, payload_bytes long, found_digest string, fields string"
)


def _urn(*parts) -> Column:
    h = F.md5(F.concat_ws("/", *(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in at)), F.lit(">"))


def _record(kind: str, rid: Column, uri: Column, content_type: str, body: Column, *headers: tuple[str, Column]) -> Column:
    """A record without the blank line that ends it; a null header is left out."""
    more = [F.when(v.isNotNull(), F.concat(F.lit(f"\r\n{k}: "), v)).otherwise(F.lit("")) for k, v in headers]
    return F.concat(
        F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), rid, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri, *more,
        F.lit(f"\r\nContent-Type: {content_type}\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(END), body,
    )


def captures(pages: DataFrame, min_revisit: int = MIN_REVISIT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The pages with their digest, and kept_id: the page_id of the response that a revisit refers to, else null.

    Digests alone are shuffled to find the revisits; these few go to the pages, unless they are more than broadcast_rows.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    digests = written(base.filter((F.octet_length("html") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "digest"), "digests")
    least = written(digests.groupBy("digest").agg(F.min("page_id").alias("kept_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "repeated_digests")
    later = dealt_join(digests, least, ["digest"], ["digest"], "page_id").filter("kept_id < page_id").select("page_id", "digest", "kept_id").distinct()
    later = written(later, "revisits")
    discard(digests, least)
    if later.limit(broadcast_rows + 1).count() <= broadcast_rows:
        later = F.broadcast(later)
    return base.join(later, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "kept_id")


def main_id(page_id: Column, digest: Column) -> Column:
    """The identifier follows from page and payload, so a revisit can name its response without a look-up."""
    return _urn("main", F.coalesce(page_id.cast("string"), F.lit("none")), digest)


def write_archives(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, file_records: int = FILE_RECORDS) -> None:
    """Write gzipped archives, three records for each page; a capture's records stay in one file."""
    rows = captures(pages, min_revisit)
    page, uri = F.col("page_id").cast("string"), F.regexp_replace("url", r"[\r\n]+", " ")
    rows = rows.withColumn("main", main_id(F.col("page_id"), F.col("digest")))
    head = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    req = F.concat(F.lit("GET / HTTP/1.1\r\nX-Page: "), F.coalesce(page, F.lit("")), F.lit(END))
    meta = F.concat(F.lit("page-id: "), F.coalesce(page, F.lit("")), F.lit("\r\npayload-bytes: "), F.octet_length("html").cast("string"), F.lit("\r\n"))
    response = _record("response", F.col("main"), uri, "application/http; msgtype=response", F.concat(head, F.col("html")), ("WARC-Payload-Digest", digest))
    revisit = _record("revisit", F.col("main"), uri, "application/http; msgtype=response", head, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")), ("WARC-Refers-To", main_id(F.col("kept_id"), F.col("digest"))))
    text = F.concat_ws(
        END,
        _record("request", _urn("request", F.col("main")), uri, "application/http; msgtype=request", req, ("WARC-Concurrent-To", F.col("main"))),
        F.when(F.col("kept_id").isNull(), response).otherwise(revisit),
        _record("metadata", _urn("metadata", F.col("main")), uri, "application/warc-fields", meta, ("WARC-Concurrent-To", F.col("main"))),
    )
    rows.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", str(max(1, file_records // 3))).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive; gzip members are inflated one by one."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            parts.append(z.decompress(data))
            data = z.unused_data
        data = b"".join(parts)
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.get("content-length", "0"))
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under a path; size and digest of a response's payload are computed anew."""
    from hashlib import sha256

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64()}.get(n, pa.string())) for n in (c.split()[0] for c in RECORD.split(", "))])

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for h, block in parse(data.as_py()):
                    kind = h.get("warc-type", "")
                    http = h.get("content-type", "").startswith("application/http")
                    payload = block.partition(b"\r\n\r\n")[2] if http else block
                    fields = block.decode("utf-8", "replace") if kind in ("metadata", "request") else None
                    page = None
                    if kind == "metadata":
                        page = next((int(v) for k, _, v in (x.partition(":") for x in fields.split("\r\n")) if k == "page-id" and v.strip()), None)
                    rows.append({
                        "record_id": h.get("warc-record-id"), "type": kind, "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"),
                        "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "content_type": h.get("content-type"),
                        "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:") or None, "page_id": page,
                        "payload": payload if with_payload and kind == "response" else None, "payload_bytes": len(payload) if kind == "response" else None, "found_digest": sha256(payload).hexdigest() if kind == "response" else None, "fields": fields,
                    })
                    size += len(block)
                    if size > 8_000_000 or len(rows) >= 1000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(fn, RECORD)


def assemble(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per capture: main, request, metadata and refers as structs; records: a written table.

    Request and metadata are found through their concurrent-to identifiers and are one row for each; a capture without
    them has null there.  refers: record_id, page_id, payload_bytes and found_digest of the response that a revisit names.
    """
    cols = ["record_id", "type", "refers_to", "target_uri", "date", "content_type", "payload_digest", "found_digest", "payload_bytes"]
    main = records.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("key"), F.struct(*cols, *(["payload"] if with_payload else [])).alias("main"))
    side = records.filter(F.col("type").isin("request", "metadata")).select(F.col("concurrent_to").alias("key"), "type", F.struct("record_id", "target_uri", "page_id", "fields").alias("r"))
    pair = side.groupBy("key").agg(F.max(F.when(F.col("type") == "request", F.col("r"))).alias("request"), F.max(F.when(F.col("type") == "metadata", F.col("r"))).alias("metadata"))
    whole = written(main.join(pair, "key", "left").drop("key"), "captures")
    named = whole.filter("main.type = 'revisit'").groupBy(F.col("main.refers_to").alias("target")).agg(F.count(F.lit(1)).alias("copies"))
    response = whole.filter("main.type = 'response'").select(F.col("main.record_id").alias("target"), F.struct("main.record_id", "metadata.page_id", "main.payload_bytes", "main.found_digest").alias("refers"))
    found = written(response.groupBy("target").agg(F.max("refers").alias("refers")).join(named, "target"), "responses")
    revisits = whole.filter("main.type = 'revisit'").withColumn("target", F.col("main.refers_to"))
    met = dealt_join(revisits, found, ["target"], ["target"], "main.record_id", how="left")
    rest = whole.filter("main.type <> 'revisit'").withColumn("refers", F.lit(None).cast(found.schema["refers"].dataType))
    return met.select(*whole.columns, "refers").unionByName(rest)


def op7_warc_assembly(pages: DataFrame) -> DataFrame:
    """The contract's columns, read back from the archives and assembled: a revisit's payload is that of the response it names."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc"
    write_archives(pages, path)
    records = written(read_archives(spark, path, with_payload=False), "records")
    whole = assemble(records, with_payload=False)
    return whole.select(
        F.col("metadata.page_id").alias("page_id"), F.coalesce("main.payload_bytes", "refers.payload_bytes").alias("payload_bytes"), F.coalesce("main.found_digest", "refers.found_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"), F.col("refers.page_id").alias("refers_to"),
    )


#: The same by DuckDB, over the view pages.
OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS least FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND least < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND least < page_id THEN least END AS refers_to
FROM m"""
