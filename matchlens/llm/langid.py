"""Language identification by error-correcting output codes over byte trigrams.

Every language has a codeword. For each of its bits a binary classifier (the log ratio of trigram probabilities of the
languages with that bit and of those without) gives a margin; the codeword with the least weighted loss wins. The weights
are how far each classifier separates each language on average, and a small lead over the next codeword marks ambiguity.
Training counts all labelled rows; only table-sized counts (DIMENSIONS per language) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import slices

DIMENSIONS = 1 << 16
EXHAUSTIVE = 5
SMOOTHING = 0.1
UNKNOWN = "und"
SLICE = 1 << 20              # bytes of text that are scored at once


def codebook(languages: int, seed: int = 10) -> np.ndarray:
    """Codewords of -1 and 1: all splits in two up to EXHAUSTIVE languages, beyond them the best of 50 random books.

    A book of one language has no split; its only bit says nothing.
    """
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= EXHAUSTIVE:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1.0 if split >> k & 1 else -1.0 for split in splits] for k in range(languages)])
    bits, random, best = int(np.ceil(10 * np.log2(languages))), np.random.default_rng(seed), (-1, None)
    for _ in range(50):
        book = random.choice([-1.0, 1.0], (languages, bits))
        book[:, np.abs(book.sum(axis=0)) == languages] = np.where(np.arange(languages) % 2, 1.0, -1.0)[:, None]
        apart = bits - book @ book.T
        np.fill_diagonal(apart, np.inf)
        if apart.min() > best[0]:
            best = (apart.min(), book)
    return best[1]


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed byte trigrams of lower-case texts in one array, and where each text's begin and end (a space on either side)."""
    lowered = [t.encode("utf-8", "surrogatepass") for t in pc.fill_null(pc.utf8_lower(texts), "").to_pylist()]
    data = np.frombuffer(b" " + b" ".join(lowered) + b"  ", np.uint8).astype(np.uint32)
    sizes = np.array([len(x) for x in lowered], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    hashed = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761) >> np.uint32(16)
    return hashed, starts, starts + sizes


@dataclass
class Model:
    languages: list[str]
    book: np.ndarray        # languages x bits
    ratios: np.ndarray      # trigrams x bits: log ratio of the two sides
    weights: np.ndarray     # languages x bits, rows sum to 1
    scale: float = 4.0

    @classmethod
    def of_counts(cls, languages: list[str], counts: np.ndarray) -> Model:
        """From counts, languages x trigrams. Each language weighs the same, however much text it has."""
        share = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * DIMENSIONS)
        book = codebook(len(languages))
        ones, zeros = (book > 0).astype(float), (book < 0).astype(float)

        def side(members: np.ndarray) -> np.ndarray:
            return (share.T @ members + 1e-12) / np.maximum(members.sum(axis=0), 1)
        ratios = np.log(side(ones)) - np.log(side(zeros)) if len(languages) > 1 else np.zeros((DIMENSIONS, 1))
        apart = np.maximum(book * (share @ ratios), 1e-6)
        return cls(languages, book, ratios.astype(np.float32), apart / apart.sum(axis=1, keepdims=True))

    def decode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: the best language's number, its score in 0 to 1, and its lead over the next (1 if there is none)."""
        hashed, starts, ends = trigrams(texts)
        bounds = np.stack([starts, ends], axis=1).ravel()
        counts = ends - starts
        sums = np.add.reduceat(self.ratios[np.append(hashed, 0)], bounds, axis=0)[::2]      # one more row: a bound may be the end
        margins = np.where(counts[:, None] > 0, sums, 0) / np.maximum(counts, 1)[:, None] * self.scale * np.minimum(counts, 64)[:, None] ** 0.5
        loss = np.log1p(np.exp(-np.clip(self.book[None] * margins[:, None, :], -50, 50)))
        loss = (loss * self.weights[None]).sum(axis=2)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        ordered = np.sort(share, axis=1)
        lead = ordered[:, -1] - ordered[:, -2] if len(self.languages) > 1 else np.ones(len(texts))
        return best, share[np.arange(len(best)), best], lead


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame) -> Model | None:
    """The model of all documents that are not held out and have a text and a language; None without any."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            hashed, starts, ends = trigrams(batch.column("text"))
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            for name in dict.fromkeys(names):
                parts = [hashed[a:b] for a, b in zip(starts[names == name], ends[names == name], strict=True)]
                found[name] = found.get(name, 0) + np.bincount(np.concatenate(parts), minlength=DIMENSIONS)
        for name, counts in found.items():
            grams = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams, pa.int32()),
                                              pa.array(counts[grams], pa.int64())], ["lang", "gram", "n"])
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(
        count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return None
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), DIMENSIONS))
    counts[rows["lang"].map({n: k for k, n in enumerate(languages)}), rows["gram"]] = rows["n"]
    return Model.of_counts(languages, counts)


def _judged(model: Model | None, texts: pa.Array, least_lead: float) -> tuple[list[str], list[float], list[bool]]:
    plain = texts.to_pylist()
    letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in plain])
    if model is None or not len(plain):
        return [UNKNOWN] * len(plain), [0.0] * len(plain), [True] * len(plain)
    best, score, lead = model.decode(texts)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
    return names, np.where(letters, np.clip(score, 0, 1), 0.0).tolist(), (~letters | (lead < least_lead)).tolist()


def predict(docs: DataFrame, model: Model | None = None, least_lead: float = 0.05) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every row, from its text alone.

    A text that is null or has no letter is `und` with score 0; so is every text if there was nothing to learn from.
    """
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            names, scores, unclear = _judged(model, batch.column("text"), least_lead)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64()), pa.array(unclear, pa.bool_())],
                                             ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, least_lead: float = 0.05) -> DataFrame:
    """The rows, with all their columns, whose text has one clear language."""
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            names, _, unclear = _judged(model, batch.column("text").cast(pa.string()), least_lead)
            keep = [n != UNKNOWN and not u for n, u in zip(names, unclear, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
