"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. A block of vectors keeps an inverted file: for each pivot, who has it near and at
which place. A query reads the lists of its own nearest pivots, ranks by the footrule distance of the two orders (weighed by the vectors'
lengths, where these differ), and the best candidates are compared exactly. All vectors are indexed; pivots are a bounded sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import written

MOST_PIVOTS = 4096           # 4 sqrt(n) up to here
NEAR = 64                    # pivots in a vector's representation
BLOCK = 4096                 # vectors of an inverted file
QUERIES = 1024               # queries that meet a block at once


def _pivots(n: int) -> int:
    return max(1, min(MOST_PIVOTS, n, int(4 * n ** 0.5)))


def _candidates(n: int) -> int:
    """Reranked candidates of a query over all blocks: they follow the square root of the vectors."""
    return int(20 * n ** 0.5) + 64


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) without the vectors that take no part: null, zero, with null or non-finite components."""
    vector = F.col("vector").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine & F.exists("vector", lambda x: x != 0))


def near_pivots(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of each vector's nearest pivots, nearest first (largest inner product with pivots of length 1)."""
    k = min(NEAR, len(pivots))
    products = vectors @ pivots.T
    best = np.argpartition(-products, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(products, best, 1), axis=1, kind="stable")
    return np.take_along_axis(best, order, 1)


def inverted(near: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of the pivots one after another: where each begins, its vectors, and their places in the order."""
    flat = near.ravel()
    order = np.argsort(flat, kind="stable")
    starts = np.searchsorted(flat[order], np.arange(n_pivots + 1))
    return starts, order // near.shape[1], order % near.shape[1]


def footrule_gain(near: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """How much less than the largest footrule distance each vector of the block is from a query: a missing pivot counts as place k.

    |i - j| summed over the pivots of both is the constant sum of all (k - place) less twice the sum of k - max(i, j) over shared ones.
    """
    starts, who, place = lists
    k = len(near)
    spans = [slice(starts[p], starts[p + 1]) for p in near]
    gains = np.concatenate([k - np.maximum(place[s], i) for i, s in enumerate(spans)])
    return np.bincount(np.concatenate([who[s] for s in spans]), weights=gains, minlength=n)


CALIBRATED = 16              # queries of a group, and their pairs with SAMPLE vectors of a block, that tell which cosine a gain stands for
SAMPLE = 256
SPREAD = 1.0                 # deviations: a long vector of uncertain direction is worth a look


def cosine_of(gains: np.ndarray, cosines: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Gains and the cosines that pairs with them may well have, ascending: a deviation above the means of bins, up to 1 for equal orders."""
    order = np.argsort(gains, kind="stable")
    bins = np.array_split(order, min(16, len(order)))
    x = np.array([gains[b].mean() for b in bins])
    y = np.maximum.accumulate(np.array([cosines[b].mean() + SPREAD * cosines[b].std() for b in bins]))
    return np.append(x, max(most, x[-1] + 1)), np.append(y, 1.0)


_BLOCK = "block int, n int, vectors binary, member_ends binary, members binary, starts binary, who binary, place binary"
_FOUND = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's `top` nearest found by largest inner product, ties to the smaller vec_id.

    Rows need vec_id and vector; the query's own vec_id is no candidate. Equal vectors are searched as one, with their top + 1 smallest ids: no
    more can be among the nearest. A repeated vec_id counts once per different vector. Vectors of another length than most have, and
    those that are not `usable`, take no part. Fewer candidates than `top`: all of them. No vectors: no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = length[0]
    rows = rows.where(F.size("vector") == dims)
    # Of equal vectors the smallest ids: cut before the shuffle, so that a vector of a third of all rows is no large group.
    ranked = rows.distinct().withColumn("_k", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(f"_k <= {top + 1}")
    classes = written(ranked.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vector-classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).limit(_pivots(n)).select("vector").toPandas()
    pivots = np.stack(sample["vector"].to_numpy()).astype(np.float64)
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(pivots)                    # at most MOST_PIVOTS vectors
    blocks = -(-n // BLOCK)
    per_block = -(-_candidates(n) // blocks)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        matrix = np.stack(frame["vector"].to_numpy()).astype(np.float64)
        starts, who, place = inverted(near_pivots(matrix, shared.value), len(shared.value))
        ends = np.cumsum(frame["ids"].map(len).to_numpy())
        return pd.DataFrame({
            "block": [int(frame["block"].iloc[0])], "n": [len(frame)], "vectors": [matrix.tobytes()], "member_ends": [ends.astype(np.int64).tobytes()],
            "members": [np.concatenate(frame["ids"].to_numpy()).astype(np.int64).tobytes()], "starts": [starts.astype(np.int64).tobytes()],
            "who": [who.astype(np.int32).tobytes()], "place": [place.astype(np.int16).tobytes()]})

    dealt = classes.withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(blocks)).cast("int"))
    index = dealt.groupBy("block").applyInPandas(build, _BLOCK)
    asked = usable(queries).where(F.size("vector") == dims).distinct()
    n_asked = asked.count()
    groups = max(1, -(-n_asked // QUERIES))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                             "asked": [np.stack(frame["vector"].to_numpy()).astype(np.float64).tobytes()]})
    packed = asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).groupBy("group").applyInPandas(gather, "ids binary, asked binary")
    meetings = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(index, "block")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield _search_block(batch.slice(at, 1).to_pylist()[0], shared.value, dims, per_block, top)

    found = meetings.mapInArrow(look, _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(f"rank <= {top}").select(
        "query_id", "rank", "vec_id", "score")


def _expected(matrix: np.ndarray, asked: np.ndarray, near_asked: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """From a query's pivots to the inner product (over the query's length) that footrule distance and length make likely for each vector.

    Orders of pivots tell directions; a vector's length is known. Of equal lengths the nearest by footrule distance come first.
    """
    n, k = len(matrix), near_asked.shape[1]
    lengths = np.linalg.norm(matrix, axis=1)
    some = np.arange(0, n, max(1, n // SAMPLE))
    few = range(min(CALIBRATED, len(asked)))
    gains = np.concatenate([footrule_gain(near_asked[q], lists, n)[some] for q in few])
    cosines = np.concatenate([matrix[some] @ asked[q] / (lengths[some] * np.linalg.norm(asked[q])) for q in few])
    x, y = cosine_of(gains, cosines, k * (k + 1) / 2)

    def worth(near: np.ndarray) -> np.ndarray:
        gain = footrule_gain(near, lists, n)
        # A little of the gain itself keeps the order where the bins' means don't rise.
        return lengths * (np.interp(gain, x, y) + gain * (1e-6 / x[-1]))
    return worth


def _search_block(row: dict, pivots: np.ndarray, dims: int, most: int, top: int) -> pa.RecordBatch:
    """The nearest of one block to each query of a group."""
    n = row["n"]
    matrix = np.frombuffer(row["vectors"]).reshape(n, dims)
    ends, members = np.frombuffer(row["member_ends"], np.int64), np.frombuffer(row["members"], np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    lists = tuple(np.frombuffer(row[c], t) for c, t in (("starts", np.int64), ("who", np.int32), ("place", np.int16)))
    ids, asked = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["asked"]).reshape(-1, dims)
    out_q, out_v, out_s = [], [], []
    near_asked = near_pivots(asked, pivots)
    worth = _expected(matrix, asked, near_asked, lists) if most < n else None
    for query_id, vector, near in zip(ids, asked, near_asked, strict=True):
        best = np.argpartition(-worth(near), most - 1)[:most] if most < n else np.arange(n)
        score = matrix[best] @ vector
        # A class more than `top`: the query's own may have no other member.
        keep = np.argsort(-score, kind="stable")[:top + 1]
        if len(keep) < len(score):
            keep = np.flatnonzero(score >= score[keep[-1]])
        for c, s in zip(best[keep], score[keep], strict=True):
            own = members[begins[c]:ends[c]]
            own = own[own != query_id][:top]
            out_v.append(own)
            out_s.append(np.full(len(own), s))
            out_q.append(np.full(len(own), query_id))
    columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, np.int64), (out_v, np.int64), (out_s, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])
