"""Interleaved document sequences: ordered text parts and media references of HTML, payloads joined by digest.

Payloads are stored as grey images (binary PGM, 64 samples of 8 bits a row), losslessly; a reference names the SHA-256
of its payload. Positions are those in the page, and a caption stays with its reference.
"""

from __future__ import annotations

import hashlib
import html
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import new_path, salted_join, slices, written

WIDTH = 64
HOT = 1024                   # references to a payload that one copy of its row serves
MEDIA_TAGS = ("img", "video", "audio", "source")
HIDDEN = ("script", "style", "noscript", "template")


class _Parts(HTMLParser):
    """(kind, text, reference, caption) in page order; a figure's caption belongs to its media."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[list] = []
        self.figure: list[int] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.text: list[str] = []

    def _end_text(self) -> None:
        text = "".join(self.text).strip()
        self.text = []
        if text:
            self.parts.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "td", "figure", "article"):
            self._end_text()
        if tag == "figcaption":
            self.caption = []
        elif tag in MEDIA_TAGS:
            self._end_text()
            given = dict(attrs)
            if given.get("src"):
                self.parts.append(["media", None, given["src"], given.get("alt") or None])
                self.figure.append(len(self.parts) - 1)

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = "".join(self.caption).strip()
            for at in self.figure if said else ():
                self.parts[at][3] = said
            self.caption = None
        elif tag == "figure":
            self.figure = []
        elif tag in ("p", "div", "article", "li", "td"):
            self._end_text()

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            self.text.append(data)

    def close(self):
        super().close()
        self._end_text()


def sequence(page: str | None) -> list[tuple]:
    """The parts of a page: (position, kind, text, reference, caption). A null or empty page has none."""
    parser = _Parts()
    parser.feed(page or "")
    parser.close()
    return [(at, *part) for at, part in enumerate(parser.parts)]


def encode_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def decode_pgm(stored: bytes) -> bytes:
    magic, size, most, samples = stored.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not a grey image of 8 bits")
    return samples


def padded(data: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of the row's width."""
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def feature(samples: bytes) -> str:
    """Mean and deviation of the samples and of the differences between rows, and the share of each quarter of the range."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    quarter = np.bincount(rows.ravel() >> 6, minlength=4)
    count = rows.size
    total, squares = int(rows.sum(dtype=np.int64)), int((rows.astype(np.int64) ** 2).sum())
    steps = int(np.abs(np.diff(rows.astype(np.int16), axis=0)).sum(dtype=np.int64)) if len(rows) > 1 else 0
    deviation = max(0.0, squares / count - (total / count) ** 2) ** 0.5
    return f"{len(rows)}x{WIDTH};mean={total / count:.4f};dev={deviation:.4f};step={steps / count:.4f};quarters=" + "/".join(map(str, quarter))


def write_media(docs: DataFrame, path: str) -> None:
    """Stores each text's payload: reference (its SHA-256), n_bytes and the image. One pass over the rows, no shuffle."""
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            seen: dict[str, tuple] = {}
            for text in batch.column("text").to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                payload = padded(data)
                name = hashlib.sha256(len(data).to_bytes(8, "little") + payload).hexdigest()
                if name not in seen:
                    seen[name] = (name, len(data), encode_pgm(payload))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*seen.values(), strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["ref", "n_bytes", "media"])
    docs.select(F.col("text").cast("string").alias("text")).mapInArrow(store, "ref string, n_bytes long, media binary").write.option(
        "compression", "zstd").parquet(path)


PAYLOADS = ("ref string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
            "media_sha256 string, feature string")


def read_media(stored: DataFrame) -> DataFrame:
    """One row per reference from the stored bytes; equal payloads that several tasks stored count once."""
    fields = [(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in PAYLOADS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = []
            for name, size, media in zip(*(batch.column(c).to_pylist() for c in ("ref", "n_bytes", "media")), strict=True):
                samples = decode_pgm(media)
                rows.append((name, size, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(media),
                             hashlib.sha256(media).hexdigest(), feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)],
                                                 schema=pa.schema(fields))
    rows = stored.mapInArrow(read, PAYLOADS)
    return rows.groupBy("ref").agg(*(F.min(c).alias(c) for c, _ in fields if c != "ref"))


PARTS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
_PART = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()),
                            ("caption", pa.string())]))


def sequences(pages: DataFrame, key: str, page: str, keep_text: bool = True) -> DataFrame:
    """key and parts: the ordered text and media structs of each page."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, page):
            parts = [[{"position": p, "kind": k, "text": t if keep_text else None, "ref": r, "caption": c} for p, k, t, r, c in sequence(x)]
                     for x in batch.column(page).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array(parts, _PART)], [key, "parts"])
    return pages.select(F.col(key).cast("long").alias(key), F.col(page).cast("string").alias(page)).mapInArrow(
        parse, f"{key} long, parts {PARTS}")


def resolve(sequenced: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """One row per media reference: key, position, ref, caption and the payload's columns (null: no such payload).

    One payload may be referred to by a third of all rows: references to it are dealt over parts of HOT, and only such a
    payload's row is sent more than once.
    """
    refs = sequenced.select(key, F.explode("parts").alias("part")).where("part.kind = 'media'").select(
        key, "part.position", "part.ref", "part.caption")
    hot = written(refs.groupBy("ref").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("parts")).where("parts > 1"), "hot-payloads")
    dealt = salted_join(refs, hot, ["ref"], [key, "position"], "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64(key, "position"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    spread = payloads.join(hot, "ref", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    return dealt.join(spread, ["ref", "part"], "left").drop("part")


def document_pages(docs: DataFrame) -> DataFrame:
    """doc_id and a page for each document: its lines as paragraphs, then a figure that names the payload made of its text."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            pages = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                data = text.encode("utf-8", "surrogatepass")
                name = hashlib.sha256(len(data).to_bytes(8, "little") + padded(data)).hexdigest()
                lines = "".join(f"<p>{html.escape(x, quote=False)}</p>" for x in text.split("\n") if x)
                pages.append(f'<article>{lines}<figure><img src="{name}"><figcaption>{len(data)} bytes of text</figcaption></figure></article>')
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pages, pa.string())], ["doc_id", "html"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        build, "doc_id long, html string")


def document_media(docs: DataFrame) -> DataFrame:
    """Per document: its payload stored, read back and resolved. Null and empty text: 64 bytes 0. Repeated rows count each.

    feature also tells how many text parts stand before the reference, so it depends on the text alone.
    """
    path = new_path(docs.sparkSession, "media")
    write_media(docs, path)
    payloads = read_media(docs.sparkSession.read.parquet(path))
    found = resolve(sequences(document_pages(docs), "doc_id", "html", keep_text=False), payloads, "doc_id")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
                        F.concat(F.lit("parts="), F.col("position").cast("string"), F.lit(";"), F.col("feature")).alias("feature"),
                        "position", "caption")
