"""Token ids as Simple-8b blocks: each 64-bit word names a layout and holds as many ids as fit.

File format (Parquet rows, one per chunk, in shard and chunk order): `words` holds the little-endian 64-bit words of all
blocks of the chunk, `offsets` the first word of each block, `doc_ids` and `ends` the documents and where their ids
end in the chunk. A block holds 1,024 ids (the last fewer), so blocks decode independently, all in one numpy pass. An id
of 60 bits or more doesn't fit any layout: its place holds 0, and `escape_at` and `escape_ids` hold it apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchlens.llm.common import new_path, slices, until_end
from matchlens.llm.tokens import SLICE, TOKENIZER, word_ids

#: Ids per word and bits per id of selectors 0 to 13.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK = 1024
CHUNK_IDS = 1 << 20
ESCAPE = 1 << 60
FILE_SCHEMA = ("shard int, chunk int, n_ids long, words binary, offsets array<int>, doc_ids array<long>, ends array<long>, "
               "escape_at array<long>, escape_ids array<decimal(20,0)>")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit words, the first word of each block, and the places of ids that are kept apart."""
    ids = ids.astype(np.uint64)
    apart = np.flatnonzero(ids >= ESCAPE)
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros((blocks, BLOCK + LAYOUTS[0][0]), np.uint64)      # zeros behind a block fit every layout
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:len(ids)] = ids
    flat[apart] = 0
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    selector = np.full((blocks, BLOCK), len(LAYOUTS) - 1, np.int8)
    widest = {1: bit_lengths(grid)}                                  # widest of the next 1, 2, 4, ... ids
    for span in (2, 4, 8, 16, 32):
        half = widest[span // 2]
        widest[span] = np.maximum(half[:, :half.shape[1] - span // 2], half[:, span // 2:])
    for k in range(len(LAYOUTS) - 2, -1, -1):                        # the layout with most ids wins
        count, bits = LAYOUTS[k]
        span = 1 << (count.bit_length() - 1)
        ahead = np.maximum(widest[span][:, :BLOCK], widest[span][:, count - span:count - span + BLOCK])
        np.copyto(selector, np.int8(k), where=ahead <= bits)
    taken = np.array([c for c, _ in LAYOUTS])
    size = np.full(blocks, BLOCK)
    if blocks:
        size[-1] = len(ids) - BLOCK * (blocks - 1)
    rows, at = np.arange(blocks), np.zeros(blocks, np.int64)
    steps = []
    while len(rows):                                                 # one word of every block that isn't done yet
        chosen = selector[rows, at]
        steps.append((rows, at, chosen))
        at = at + taken[chosen]
        left = at < size[rows]
        rows, at = rows[left], at[left]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), apart
    row, at, chosen = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(row, kind="stable")
    row, at, chosen = row[order], at[order], chosen[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for k, (count, bits) in enumerate(LAYOUTS):
        mine = np.flatnonzero(chosen == k)
        if len(mine):
            values = grid.ravel().take((row[mine] * grid.shape[1] + at[mine])[:, None] + np.arange(count))
            words[mine] |= np.bitwise_or.reduce(values << (np.arange(count) * bits).astype(np.uint64), axis=1)
    return words, np.searchsorted(row, np.arange(blocks)), apart


def bit_lengths(ids: np.ndarray) -> np.ndarray:
    """Bits of each number, by the exponents of its halves."""
    low = (ids & np.uint64(0xFFFFFFFF)).astype(np.float64).view(np.uint64) >> np.uint64(52)
    low = (np.maximum(low, np.uint64(1022)) - np.uint64(1022)).astype(np.uint8)
    high = ids >> np.uint64(32)
    if not high.any():
        return low
    return np.where(high != 0, np.frexp(high.astype(np.float64))[1].astype(np.uint8) + np.uint8(32), low)


def unpack(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of a chunk; those kept apart are 0."""
    out = np.zeros(n_ids, np.uint64)
    if not n_ids:
        return out
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in LAYOUTS])[chosen]
    upto = np.cumsum(counts) - counts
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    at = block * BLOCK + upto - upto[offsets][block]                 # where each word's first id goes
    ends = np.minimum((block + 1) * BLOCK, n_ids)
    for k, (count, bits) in enumerate(LAYOUTS):
        mine = np.flatnonzero(chosen == k)
        if len(mine):
            values = (words[mine][:, None] >> (np.arange(count) * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
            to = at[mine][:, None] + np.arange(count)
            inside = to < ends[mine][:, None]
            out[to[inside]] = values[inside]
    return out


def write_tokens(docs: DataFrame, path: str, end: int = 1, tokenizer: str = TOKENIZER) -> None:
    """Writes the ids of every text in ascending doc_id order (null ids first, ties by text; null text: only `end`).

    The rows are dealt by ranges of doc_id: shard k holds smaller ids than shard k + 1. A shard is written as a stream of
    chunks, so a task holds one chunk and one slice of texts at a time.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, table = TaskContext.get().partitionId(), 0, word_ids(tokenizer)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        ends: list[int] = []

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            words, offsets, apart = pack(ids)
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "chunk": chunk, "n_ids": len(ids), "words": words.astype("<u8").tobytes(),
                "offsets": offsets.tolist(), "doc_ids": names, "ends": ends,
                "escape_at": apart.tolist(), "escape_ids": [int(i) for i in ids[apart]]}], schema=_FILE_ARROW)

        for batch in until_end(slices(batches, "text", SLICE), table.rest):
            ids, bounds = table.encode(batch.column("text"), end)
            for doc_id, lo, hi in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                held.append(ids[lo:hi])
                names.append(doc_id)
                ends.append((ends[-1] if ends else 0) + int(hi - lo))
                if ends[-1] >= CHUNK_IDS:
                    yield flush()
                    held, names, ends, chunk = [], [], [], chunk + 1
        if names:
            yield flush()

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
     .mapInArrow(encode, FILE_SCHEMA).write.parquet(path))


_FILE_ARROW = pa.schema([
    ("shard", pa.int32()), ("chunk", pa.int32()), ("n_ids", pa.int64()), ("words", pa.binary()), ("offsets", pa.list_(pa.int32())),
    ("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("escape_at", pa.list_(pa.int64())),
    ("escape_ids", pa.list_(pa.decimal128(20, 0)))])


def chunk_ids(row: dict) -> np.ndarray:
    """All ids of a chunk as it was read."""
    ids = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["offsets"], np.int64), row["n_ids"])
    for at, value in zip(row["escape_at"], row["escape_ids"], strict=True):
        ids[at] = int(value)
    return ids


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files), n_tokens and the crc32 of its ids."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                data, ends = chunk_ids(row).astype("<u4").tobytes(), row["ends"]
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_pydict({
                    "shard": [row["shard"]] * len(ends), "chunk": [row["chunk"]] * len(ends), "before": starts,
                    "doc_id": row["doc_ids"], "n_tokens": [b - a for a, b in zip(starts, ends, strict=True)],
                    "ids_crc32": [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts, ends, strict=True)]}, schema=decoded)

    decoded = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()),
                         ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # One row per chunk of a million ids: the running sum over shards and chunks stays small.
    first = files.select("shard", "chunk", "n_ids").withColumn(
        "in_shard", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids"))
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("ids")).withColumn(
        "shards_before", F.sum("ids").over(Window.orderBy("shard")) - F.col("ids"))
    first = first.join(shards, "shard").select("shard", "chunk", (F.col("in_shard") + F.col("shards_before")).alias("first"))
    docs = files.mapInArrow(decode, "shard int, chunk int, before long, doc_id long, n_tokens long, ids_crc32 long")
    return docs.join(first, ["shard", "chunk"]).select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def simple8b(spark: SparkSession, docs: DataFrame, end: int = 1, tokenizer: str = TOKENIZER) -> DataFrame:
    """Writes the documents' ids and reads them back. No documents: no rows. Repeated rows are written each."""
    path = new_path(spark, "tokens")
    write_tokens(docs, path, end, tokenizer)
    return read_tokens(spark, path)
