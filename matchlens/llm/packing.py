"""Packing of documents into sequences of equal cost: descending lengths, each to the cheapest sequence with room.

A sequence's cost is linear in its tokens and quadratic in each piece (attention stays inside a piece). Documents are taken in
groups of about a million tokens as the rows come; a group fills its sequences exactly: a piece that fits nowhere is cut at the
largest room. What a group has over whole sequences goes to sequences of a power of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import slices, until_end
from matchlens.llm.tokens import SLICE, TOKENIZER, word_ids

GROUP_TOKENS = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECES.split(", ")])


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one group, and the number of its sequences."""
    pieces, rest, sequence = [], [], 0
    for doc, length in enumerate(lengths):
        whole = length // capacity
        for k in range(whole):
            pieces.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
        if length % capacity:
            rest.append((-(length % capacity), doc, whole * capacity))
    total = -sum(x for x, _, _ in rest)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1)
                                                if total % capacity >> b & 1]
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    used = np.zeros(len(sizes), np.int64)
    heapq.heapify(rest)
    while rest:
        negative, doc, start = heapq.heappop(rest)
        length = -negative
        fits = room >= length
        if fits.any():
            at = int(np.argmin(np.where(fits, cost, np.inf)))
        else:
            at = int(np.argmax(room))
            heapq.heappush(rest, (int(room[at]) - length, doc, start + int(room[at])))
            length = int(room[at])
        pieces.append((doc, start, length, sequence + at, int(used[at])))
        room[at] -= length
        used[at] += length
        cost[at] += linear * length + quadratic * length * length
    return pieces, sequence + len(sizes)


def pack_documents(docs: DataFrame, capacity: int = 4096, end: int = 2, linear: float = 1.0, quadratic: float = 1 / 4096,
                   tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece. Every row is packed on its own, repeated ones too; a null or empty text is the end id alone.

    No shuffle: the result needs only whole groups of some million tokens, and every task has many. sequence_id holds the
    task in its upper bits. Rows need doc_id and text; other columns are ignored. No rows give no pieces.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sequence = word_ids(tokenizer), TaskContext.get().partitionId() << 36
        names: list[int | None] = []
        held: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            pieces, n = assign([len(x) for x in held], capacity, linear, quadratic)
            pieces.sort(key=lambda p: (p[3], p[4]))
            rows = [(names[d], s, length, zlib.crc32(held[d][s:s + length]), len(held[d]), sequence + q, o)
                    for d, s, length, q, o in pieces]
            sequence += n
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)

        for batch in until_end(slices(batches, "text", SLICE), table.rest):
            ids, bounds = table.encode(batch.column("text"), end)
            ids = ids.astype("<u4")
            for doc_id, lo, hi in zip(batch.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False):
                names.append(doc_id)
                held.append(ids[lo:hi])
                tokens += int(hi - lo)
                if tokens >= GROUP_TOKENS:
                    yield flush()
                    names, held, tokens = [], [], 0
        if names:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
