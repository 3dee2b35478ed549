"""Line dedup by a log-template tree.

A line's leaf is given by its token count and its first tokens; tokens with a digit or an @ are variable from the start. In a
leaf, a token is constant if lines of enough documents have it at that position; the other positions are variable fields. Lines with equal
constants, also some behind the first tokens, share a template, and a template that recurs across documents is boilerplate: its first occurrence stays, all others go.

Equal texts count as one document, so a copied document alone makes no line boilerplate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlens.llm.common import free_names, salted_join, slices, written

DEPTH = 3
MIN_TOKENS = 3               # shorter lines have no tokens besides the leading ones
LEAST_CONSTANT = 0.5         # of the tokens after the leading ones


@dataclass(frozen=True)
class Rule:
    """Which lines recur."""
    min_documents: int = 3       # that share a template, and votes of a constant
    vote_share: float = 0.25     # a constant has votes of this part of its leaf's documents as well
    long_tokens: int = 50        # equal lines of more tokens recur from long_documents on
    long_documents: int = 2
    short_documents: int = 5     # equal lines of fewer than MIN_TOKENS tokens recur from so many on


_VARIABLE = re.compile(rb"[0-9@]").search
STAR = b"<*>"


def masked(line: bytes) -> list[bytes]:
    return [STAR if _VARIABLE(t) else t for t in line.split()]


def _hash(tokens: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b"\x00".join(tokens)) - (1 << 63)


def leaf_of(tokens: list[bytes]) -> int:
    return _hash([b"%d" % len(tokens), *tokens[:DEPTH]])


_LINES = "doc_id long, doc_hash long, line int, leaf long, body long, size int"


def body_of(line: bytes, tokens: list[bytes]) -> int:
    """The name of the masked line; where most tokens are variable, that of the line itself."""
    return _hash(line.split() if 2 * tokens.count(STAR) > len(tokens) else tokens)


def _lines(texts: DataFrame) -> DataFrame:
    """Leaf, body and number of tokens of every line that has tokens."""
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, doc_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_hash", "text")), strict=True):
                for at, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    tokens = masked(line)
                    if tokens:
                        for column, value in zip(out, (doc_id, doc_hash, at, leaf_of(tokens), body_of(line, tokens), len(tokens)), strict=True):
                            column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()),
                                                                                strict=True)], ["doc_id", "doc_hash", "line", "leaf", "body", "size"])
    return texts.mapInArrow(parse, _LINES)


def _tokens(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """leaf, body and tokens of the wanted lines (doc_id, doc_hash, line, leaf, body): one line for each body."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], []]
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                own = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
                for one in lines:
                    out[0].append(one["leaf"])
                    out[1].append(one["body"])
                    out[2].append([_hash([t]) for t in masked(own[one["line"]])])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))],
                                                 ["leaf", "body", "tokens"])
    per_doc = wanted.groupBy("doc_id", "doc_hash").agg(F.collect_list(F.struct("line", "leaf", "body")).alias("lines"))
    return _with(texts, per_doc, "inner").select("text", "lines").mapInArrow(pick, "leaf long, body long, tokens array<long>")


def _with(texts: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    other = per_doc.withColumnsRenamed({"doc_id": "_doc", "doc_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("doc_hash") == F.col("_hash"))
    return texts.join(other, same, how)


def _documents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and docs: how many distinct texts have them; with the first occurrence."""
    single = rows.groupBy(*keys, "doc_hash").agg(F.min(F.struct("doc_id", "line", "doc_hash")).alias("first"))
    return single.groupBy(*keys).agg(F.count(F.lit(1)).alias("docs"), F.min("first").alias("first"))


def _templates(texts: DataFrame, lines: DataFrame, rule: Rule) -> DataFrame:
    """leaf, body, template for the lines of leaves in which several bodies may share one; n_constant and n_tokens with it."""
    bodies = written(_documents(lines, ["leaf", "body", "size"]), "bodies")
    leaves = bodies.where(f"size >= {MIN_TOKENS}").groupBy("leaf").agg(F.sum("docs").alias("in_leaf"), F.count(F.lit(1)).alias("bodies"), F.min("docs").alias("least")).where(
        f"bodies > 1 and in_leaf >= {rule.min_documents} and least < {rule.min_documents}")
    leaves = written(leaves, "leaves")
    wanted = salted_join(bodies, leaves.select("leaf"), ["leaf"], ["body"])
    tokens = _tokens(texts, wanted.select("first.doc_id", "first.doc_hash", "first.line", "leaf", "body"))
    tokens = written(tokens.dropDuplicates(["leaf", "body"]).join(bodies.select("leaf", "body", "docs"), ["leaf", "body"]), "line-tokens")
    each = tokens.select("leaf", "body", "docs", F.posexplode("tokens").alias("at", "token"))
    constant = each.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("votes")).where(F.col("votes") >= rule.min_documents)
    constant = constant.join(leaves.select("leaf", "in_leaf"), "leaf").where(F.col("votes") >= F.col("in_leaf") * rule.vote_share).drop("in_leaf")
    kept = salted_join(each, constant.where(F.col("token") != _hash([STAR])).drop("votes"), ["leaf", "at", "token"], ["body"])
    found = kept.groupBy("leaf", "body").agg(F.bit_xor(F.xxhash64("at", "token")).alias("template"), F.sum((F.col("at") >= DEPTH).cast("long")).alias("n_constant"))
    n_constant = F.coalesce("n_constant", F.lit(0))
    enough = (n_constant >= (F.col("n_tokens") - DEPTH) * LEAST_CONSTANT) & (n_constant > 0)
    return tokens.select("leaf", "body", F.size("tokens").alias("n_tokens")).join(found, ["leaf", "body"], "left").select(
        "leaf", "body", F.when(enough, F.col("template")).otherwise(F.col("body")).alias("template"))


def recurring_lines(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, doc_hash and drops (numbers of the lines that go) of the documents that lose lines."""
    texts = _texts(docs)
    lines = written(_lines(texts), "lines")
    templates = written(_templates(texts, lines, rule), "templates")
    # A body may stand in a third of all lines: its template is sent to salted rows.
    named = salted_join(lines, templates, ["leaf", "body"], ["doc_hash", "line"], "left").withColumn("template", F.coalesce("template", "body"))
    least = F.when(F.col("size") < MIN_TOKENS, rule.short_documents).otherwise(rule.min_documents)
    recurring = _documents(named, ["leaf", "template", "size"]).where(F.col("docs") >= least).drop("size")
    hit = salted_join(named, recurring, ["leaf", "template"], ["doc_hash", "line"])
    gone = hit.where(~_is_first()).select("doc_id", "doc_hash", "line")
    long = lines.where(F.col("size") > rule.long_tokens)
    copied = _documents(long, ["leaf", "body"]).where(F.col("docs") >= rule.long_documents)
    # The first line of a template is the first of its body too, so no line loses its last copy.
    gone = gone.unionByName(salted_join(long, copied, ["leaf", "body"], ["doc_hash", "line"]).where(~_is_first()).select("doc_id", "doc_hash", "line"))
    return gone.groupBy("doc_id", "doc_hash").agg(F.collect_set("line").alias("drops"))


def _is_first() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line") == F.col("first.line")) & (F.col("doc_hash") == F.col("first.doc_hash"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc_hash().alias("doc_hash"), F.col("text").cast("string").alias("text"))


def _doc_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def deduped(docs: DataFrame, rule: Rule = Rule(), counts: bool = True) -> DataFrame:
    """The rows of docs, text without the lines that go and n_chars (if there) to match; with the counts n_lines and n_dropped, in
    place of columns of that name, if wanted.

    A null text stays null and has no lines; an empty one has one. Lines without tokens stay. Repeated rows are treated alike. A
    document that loses all its lines stays, with an empty text.
    """
    added = ["n_lines", "n_dropped"] if counts else []
    columns = [c for c in docs.columns if c.lower() not in added]
    name, hashed, lines = free_names(docs, "doc", "hash", "drops")
    drops = recurring_lines(docs, rule).withColumnsRenamed({"doc_id": name, "doc_hash": hashed, "drops": lines})
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(name)) & (F.xxhash64(docs["text"].cast("string")) == F.col(hashed))
    joined = docs.join(drops, same, "left").select(*(docs[c] for c in columns), F.coalesce(lines, F.array().cast("array<int>")).alias(lines))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column(lines).to_pylist(), strict=True):
                own = [] if text is None else text.split("\n")
                gone = set(drop)
                texts.append(text if not gone else "\n".join(x for k, x in enumerate(own) if k not in gone))
                n_lines.append(len(own))
                n_dropped.append(len(gone))
            arrays = {c: batch.column(c) for c in columns} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                lengths = np.array([len(t) if t is not None else -1 for t in texts])
                same_text = np.array(n_dropped) == 0
                new = pa.array(lengths, pa.int64(), mask=lengths < 0).cast(batch.column("n_chars").type)
                arrays["n_chars"] = pa.compute.if_else(pa.array(same_text), batch.column("n_chars"), new)
            counted = {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())} if counts else {}
            yield pa.RecordBatch.from_arrays([*arrays.values(), *counted.values()], [*arrays, *counted])
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in added])
    return joined.mapInArrow(rewrite, schema)
