"""WARC archives of web pages: written as request, response (or revisit) and metadata records, read back as captures.

Archives are gzipped WARC files that Spark's text writer makes: a record is one value, the blank lines after it are the line
separator. Only a page whose payload no page of smaller id has is stored whole; the others revisit it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm.common import new_path, written

#: The alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
FILE_BYTES = 24 << 20
SALTS = 16
EPOCH = "2024-01-01T00:00:00Z"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base 32 of the SHA-1: five hex digits are four characters."""
    digits = F.sha1(data)
    parts = []
    for k in range(0, 40, 5):
        value = F.conv(F.substring(digits, k + 1, 5), 16, 10).cast("int")
        parts += [F.lit(BASE32).substr(F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """A whole record but for the two blank lines at its end. A null header is left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), record_id),
             F.lit(f"WARC-Date: {EPOCH}"), *(F.concat(F.lit(f"{n}: "), v) for n, v in headers),
             F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def _urn(kind: str, page_id: Column, digest: Column) -> Column:
    return F.concat(F.lit(f"<urn:{kind}:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(">"))


def captures(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """One row per page and payload: page_id, digest, size, url, n (equal rows), refers_to (null: stored whole)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), base32_sha1(payload.cast("binary")).alias("digest"),
                        F.octet_length(payload).cast("long").alias("size"), F.col("url").cast("string").alias("url"))
    rows = written(rows.groupBy("page_id", "digest", "size").agg(F.min("url").alias("url"), F.count(F.lit(1)).alias("n")), "warc-captures")
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("pages")).where("pages > 1")
    # One payload may be that of a third of all pages: its rows are dealt over salts, its single first row to each of them.
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    later = (F.col("size") >= min_revisit) & (F.col("first_id") < F.col("page_id"))
    return salted.join(firsts, ["digest", "salt"], "left").select(
        "page_id", "digest", "size", "url", "n", F.when(later, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_revisit: int = 0) -> None:
    """Writes all records under path. Payloads travel only for pages that are stored whole."""
    spark = pages.sparkSession
    known = written(captures(pages, min_revisit), "warc-decisions")
    stored = known.where("refers_to is null")
    page, digest, n = F.col("page_id"), F.col("digest"), F.col("n").cast("string")
    response, request, metadata = (_urn(kind, page, digest) for kind in ("response", "request", "metadata"))
    target = F.coalesce(F.regexp_replace("url", r"[\r\n]", " "), F.lit("urn:none"))
    labelled = F.concat(F.lit("sha1:"), digest)
    http = "application/http; msgtype=response"
    payload = F.coalesce(F.col("html"), F.lit(""))
    bodies = pages.select(page.cast("long").alias("page_id"), "html").withColumn("digest", base32_sha1(payload.cast("binary")))
    whole = stored.join(bodies, stored["page_id"].eqNullSafe(bodies["page_id"]) & (stored["digest"] == bodies["digest"])).select(
        stored["*"], bodies["html"])
    whole = whole.select(_record(
        "response", response, [("WARC-Target-URI", target), ("WARC-Payload-Digest", labelled)], http,
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), payload)).alias("value"))
    small = []
    small.append(known.where("refers_to is not null").select(_record(
        "revisit", response, [("WARC-Target-URI", target), ("WARC-Payload-Digest", labelled),
                              ("WARC-Refers-To", _urn("response", F.col("refers_to"), digest)),
                              ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))],
        http, F.lit("HTTP/1.1 200 OK\r\n\r\n")).alias("value")))
    small.append(known.select(_record(
        "request", request, [("WARC-Target-URI", target), ("WARC-Concurrent-To", response)],
        "application/http; msgtype=request", F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\n\r\n"))).alias("value")))
    small.append(known.select(_record(
        "metadata", metadata, [("WARC-Target-URI", target), ("WARC-Concurrent-To", response)], "application/warc-fields",
        F.concat_ws("\r\n", F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit(""))), F.concat(F.lit("payload-bytes: "), F.col("size").cast("string")),
                    F.concat(F.lit("rows: "), n), F.concat(F.lit("refers-to-page: "), F.coalesce(F.col("refers_to").cast("string"), F.lit(""))),
                    F.lit(""))).alias("value")))
    records = whole
    for part in small:
        records = records.unionByName(part)
    total = known.agg(F.sum(F.when(F.col("refers_to").isNull(), F.col("size")).otherwise(0) + 1500), F.count(F.lit(1))).first()
    per_file = max(1, int(FILE_BYTES * (total[1] or 1) / (total[0] or 1)))
    # No exchange of payloads but that of the join: its partitions are written as they are, in files of about FILE_BYTES.
    records.select("value").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


_RAW = ("kind string, record_id string, concurrent_to string, digest string, refers_to string, block_bytes long, payload_bytes long, "
        "read_digest string, page_id long, n long, refers_to_page long")
_RAW_ARROW = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("digest", pa.string()),
                        ("refers_to", pa.string()), ("block_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("read_digest", pa.string()),
                        ("page_id", pa.int64()), ("n", pa.int64()), ("refers_to_page", pa.int64())])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of each record, found by its Content-Length."""
    view, at = memoryview(data), 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:head].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in lines)
        start = head + 4
        length = int(headers["Content-Length"])
        yield headers, view[start:start + length]
        at = start + length + 4


def _fields(block: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives; a file is one row of bytes in its task and holds about FILE_BYTES, or few long records."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for head, block in records_of(gzip.decompress(content.as_py())):
                    kind, number = head["WARC-Type"], lambda x: int(x) if x else None
                    row = {"kind": kind, "record_id": head["WARC-Record-ID"], "concurrent_to": head.get("WARC-Concurrent-To"),
                           "digest": head.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
                           "refers_to": head.get("WARC-Refers-To"), "block_bytes": len(block)}
                    if kind == "response":
                        raw = bytes(block)
                        payload = raw[raw.index(b"\r\n\r\n") + 4:]
                        row |= {"payload_bytes": len(payload), "read_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
                    elif kind == "metadata":
                        own = _fields(bytes(block))
                        row |= {"page_id": number(own.get("page-id")), "n": int(own["rows"]), "payload_bytes": int(own["payload-bytes"]),
                                "refers_to_page": number(own.get("refers-to-page"))}
                    rows.append(row)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RAW_ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path)
    return files.select("content").mapInArrow(parse, _RAW)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the records that name each other by WARC-Concurrent-To, joined as equal keys.

    capture_id is the id of the response or revisit; request and metadata point to it. Record ids are unique, so no group is
    larger than a capture and its repetitions.
    """
    key = F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))
    keyed = records.withColumn("capture_id", key)

    def one(kinds: tuple[str, ...], *columns: str) -> Column:
        return F.max(F.when(F.col("kind").isin(*kinds), F.struct(*columns)))
    return keyed.groupBy("capture_id").agg(
        one(("response", "revisit"), "kind", "record_id", "digest", "read_digest", "payload_bytes", "refers_to").alias("response"),
        one(("request",), "record_id", "block_bytes").alias("request"),
        one(("metadata",), "record_id", "page_id", "n", "payload_bytes", "refers_to_page").alias("metadata"))


def transactions(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Writes the pages' archives, reads them back and assembles the captures.

    Null html is an empty payload, a null url the target urn:none, a null page_id a page without id (never referred to). Equal
    rows are written once and counted in the metadata record. No pages: no captures.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_revisit)
    return assemble(read_records(pages.sparkSession, path))


def page_rows(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each capture, once per row of pages.

    Both payload figures of a response are those of the bytes read back; a revisit's payload is not in the archives, its figures
    are those that its own headers and metadata state.
    """
    whole = F.col("response.kind") == "response"
    return found.withColumn("_k", F.explode(F.array_repeat(F.lit(0), F.col("metadata.n").cast("int")))).select(
        F.col("metadata.page_id").alias("page_id"),
        F.when(whole, F.col("response.payload_bytes")).otherwise(F.col("metadata.payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.col("response.read_digest")).otherwise(F.col("response.digest")).alias("payload_digest"),
        F.col("response.kind").alias("record_type"), F.col("metadata.refers_to_page").alias("refers_to"))
