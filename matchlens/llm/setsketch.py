"""MinHash near-dedup by SetSketch registers.

Every shingle is the source of a Poisson process whose points fall into M registers at random; a register keeps its earliest point x as
the whole number K = 1 - log_B(x), cut to 0 .. TOP: minima, truncated to exponentially spaced values. The registers of a union
are the larger ones of both, and two sets have equal registers about as often as shingles are common to them.

Sets with the same registers in one of BANDS bands are candidates. Likelihood of the larger, smaller and equal registers, given both sizes,
tells which similarities a pair can have; pairs that can reach the wanted one are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import salted_join, slices, small_ids, until_end, written
from matchlens.llm.components import components
from matchlens.llm.partenum import BLOCK, FLAGS, LONG, long_bits, parities, possible, set_key, sets_of, verified
from matchlens.llm.shingles import forget_words, mixed, shingle_set

BANDS, WIDTH = 40, 5         # a pair of similarity 0.8 is no candidate with chance (1 - 0.8 ** 5) ** 40, below 2 in ten million
M = BANDS * WIDTH
BASE = 1.001                 # neighbouring register values are 0.1 % apart: registers agree almost as often as minima do
RATE = 20.0                  # so K > 0 for a single shingle, but for a chance of exp(-20)
TOP = 65_534                 # BASE ** TOP is 3e28: no set comes there
CHUNK = 25_000               # sets whose bands a task compares before it deals them out
FIRST_ROUND = 8              # one band of so many makes most links; the others only see what is still apart
DOUBT = 14.0                 # nats by which a similarity has to be less likely than the best one before it is ruled out: 5.3 sigma
POINTS = 2048
_LOG = np.log(BASE)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit numbers; all 0 for the empty set.

    The points of a shingle come at exponential distances, M RATE in a unit of time, each in a random register. Shingles whose
    next point is later than the latest register's are done: a set of n costs about n + M ln M points, not n M.
    """
    earliest = np.full(M, np.inf)
    state, time, done = mixed(shingles ^ _GOLDEN), np.zeros(len(shingles)), 0
    while len(state):
        steps = max(1, POINTS // len(state))             # how many points at once makes no difference to them
        points = mixed(state[:, None] + np.arange(done + 1, done + steps + 1, dtype=np.uint64) * _GOLDEN)
        waits = -np.log1p(-(points >> np.uint64(11)).astype(np.float64) * 2.0 ** -53) / (M * RATE)
        times = np.cumsum(np.concatenate([time[:, None], waits], axis=1), axis=1)[:, 1:]
        register = (mixed(points ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(M)).astype(np.int64)
        np.minimum.at(earliest, register.ravel(), times.ravel())
        going = times[:, -1] <= earliest.max()
        state, time, done = state[going], times[going, -1], done + steps
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(earliest) / _LOG), 0, TOP + 1).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit name for the registers of each band."""
    name = mixed(np.arange(BANDS, dtype=np.uint64))
    for column in values.reshape(BANDS, WIDTH).T.astype(np.uint64):
        name = mixed(name + column + np.uint64(1))
    return name.astype(np.int64)


def log_likelihood(similarity: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Of a Jaccard similarity, given set sizes and how many of the M registers are larger in a and in b.

    Of the shingles of both sets, the part that only a has makes a's register larger with chance -log_B(1 - x (B - 1) / B).
    """
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    common = similarity / (1 + similarity)               # of n_a + n_b

    def chance(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / _LOG, 1e-12, 1.0)
    # Shares of the union: a's own part is (u - common) / (1 - common).
    own_a, own_b = (u - common) / (1 - common), (v - common) / (1 - common)
    up, down = chance(own_a), chance(own_b)
    return more * np.log(up) + less * np.log(down) + (M - more - less) * np.log(np.clip(1 - up - down, 1e-12, 1.0))


def can_reach(percent: int, n_a: np.ndarray, n_b: np.ndarray, k_a: np.ndarray, k_b: np.ndarray) -> np.ndarray:
    """Whether the pairs' sizes and registers leave a similarity of percent / 100 or more possible.

    The likelihood has one peak; it is found by golden section over the similarities that the sizes allow.
    """
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    more, less = (k_a > k_b).sum(axis=1), (k_a < k_b).sum(axis=1)
    highest = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    low, high, ratio = np.zeros(len(n_a)), highest.copy(), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        left, right = high - ratio * (high - low), low + ratio * (high - low)
        better = log_likelihood(left, n_a, n_b, more, less) > log_likelihood(right, n_a, n_b, more, less)
        low, high = np.where(better, low, left), np.where(better, right, high)
    best, wanted = (low + high) / 2, np.minimum(percent / 100, highest)
    lost = log_likelihood(best, n_a, n_b, more, less) - log_likelihood(wanted, n_a, n_b, more, less)
    return (highest * 100 >= percent - 1e-9) & ((best >= wanted) | (lost <= DOUBT))


# --- Spark ------------------------------------------------------------------------------------------------------------------

_SKETCH = "doc_id long, set long, n long, registers binary, flags array<long>, more array<long>"


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, set (its 64-bit name), n (its size), registers and parities of every document; a set without shingles has none."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in until_end(slices(batches, "text"), forget_words):
            columns: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, width)
                n = len(shingles)
                row = (set_key(shingles), n, registers(shingles).tobytes() if n else None, parities(shingles) if n else None,
                       parities(shingles, long_bits(n)) if n > LONG else None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "set", "n", "registers", "flags", "more"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(sketch, _SKETCH)


def _repeated(band: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows whose band stands there more than once, and one row of every band."""
    order = np.lexsort((key, band))
    band, key = band[order], key[order]
    first = np.concatenate([[True], band[1:] != band[:-1]]) if len(band) else np.zeros(0, bool)
    shared = ~first
    shared[:-1] |= ~first[1:]
    return band[shared], key[shared], band[first], key[first]


def _members(distinct: DataFrame) -> DataFrame:
    """band and set of all bands that several sets share.

    A task compares the bands of its own sets first and deals out one set for each: no part follows the size of a group of copies.
    """
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-distinct.count() // CHUNK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        turn = TaskContext.get().partitionId() * 7919

        def flush() -> pa.RecordBatch:
            keys = np.concatenate([k for k, _ in held])
            names = np.concatenate([bands(np.frombuffer(x, "<u2")) for _, all_of in held for x in all_of])
            band, key, one, of_one = _repeated(names, np.repeat(keys, BANDS))
            part = np.mod(one, parts)
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, False, one[order[a:b]].tobytes(), of_one[order[a:b]].tobytes()) for p, (a, b) in enumerate(pairwise(edges)) if b > a]
            rows.append((parts + turn % parts, True, band.tobytes(), key.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)],
                                              ["part", "local", "bands", "sets"])
        for batch in batches:
            held.append((batch.column("set").to_numpy(), batch.column("registers").to_pylist()))
            if sum(len(k) for k, _ in held) >= CHUNK:
                yield flush()
                held, turn = [], turn + 1
        if held:
            yield flush()

    def meet(packed: pa.Table) -> pa.Table:
        local = packed.column("local").to_numpy()
        read = [np.frombuffer(b"".join(packed.filter(pa.array(local == x)).column(c).to_pylist()), "<i8") for x in (True, False) for c in ("bands", "sets")]
        band, key, _, _ = _repeated(*read[2:])
        return pa.table({"band": np.concatenate([read[0], band]), "set": np.concatenate([read[1], key])})
    dealt = distinct.select("set", "registers").mapInArrow(deal, "part long, local boolean, bands binary, sets binary")
    return dealt.groupBy("part").applyInArrow(meet, "band long, set long").distinct()


def _likely(pairs: DataFrame, distinct: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and registers allow the similarity."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k_a, k_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, M) for c in ("k_a", "k_b"))
            fine = can_reach(percent, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), k_a, k_b)
            yield batch.select(["a", "b"]).filter(pa.array(fine))
    ids = small_ids(pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))), "sketch-sides")
    sized = distinct.select("set", "n", "registers").join(ids, "set", "left_semi")
    for side in ("a", "b"):
        own = sized.select(F.col("set").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"k_{side}"))
        other = "b" if side == "a" else "a"
        pairs = salted_join(pairs, own, [side], [other])
    sizes_allow = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return pairs.where(sizes_allow).mapInArrow(test, "a long, b long")


def links(docs: DataFrame, sketched: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between sets that connect all that similar sets connect.

    The sets of a band meet its hub, the one that meets most others: those of some bands first, then those of the others that aren't connected with it by
    then, then what is still apart a hub of its own. Only what this leaves in other components than the hub meets members of other components, block by
    block, and goes on if sizes and parities (a bound of the difference of two sets) allow it: a large group of copies costs about as many pairs as it has members.
    """
    distinct = sketched.where("n > 0").groupBy("set").agg(
        F.min("n").alias("n"), F.min(F.struct("registers", "flags", "more")).alias("sketch"), F.min("doc_id").alias("doc_id"))
    distinct = written(distinct.select("set", "n", "sketch.*", "doc_id"), "sketched-sets")
    everyone = written(_members(distinct), "members")
    sizes = written(everyone.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("set")).alias("who")).where("m > 1"), "bands")
    # Close copies share many bands: of bands with the same members one is enough.
    sized = salted_join(everyone, sizes.groupBy("m", "who").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("alike")), ["band"], ["set"])
    # What copies were made of meets more of them than any copy does. It is a group's hub: the copies may be too far apart from each other.
    central = sized.groupBy("set").agg(F.sum(F.col("m") * F.col("alike")).alias("meets"))
    wide = written(salted_join(sized.select("band", "set", "m"), central, ["set"], ["band"]), "band-members")
    labels = written(wide.select(F.col("set").alias("node"), F.col("set").alias("label")).distinct(), "labels")
    early = F.pmod(F.xxhash64("band"), F.lit(FIRST_ROUND)) == 0
    found = None
    # The hub of some bands, of the others, then of what isn't connected with it.
    for members, apart_only in ((wide.where(early), False), (wide.where(~early), False), (wide, True)):
        star = _star(members, labels, apart_only)
        near = written(_checked(docs, distinct, written(_likely(star, distinct, percent), "likely"), width, percent), "links")
        found = near if found is None else found.union(near)
        named = components(found)
        labels = written(labels.select("node").join(named, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    marked = _hubs(wide, labels, False).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    marked = marked.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    parity = distinct.select("set", "n", "more", *(F.col("flags")[k].alias(f"f{k}") for k in range(FLAGS // 64)))
    marked = written(marked.join(parity, "set"), "marked")
    others = marked.where("label <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Parquet stores what a set repeats for each of its bands once: no broadcast of many times its files' size.
    met = others.alias("a").join(marked.alias("b").hint("merge"), (F.col("a.band") == F.col("b.band")) & (F.col("a.block") == F.col("b.block"))
                                 & (F.col("a.label") != F.col("b.label")) & possible(percent, "a", "b"))
    rest = written(met.select(F.least("a.set", "b.set").alias("a"), F.greatest("a.set", "b.set").alias("b")).distinct(), "rest-pairs")
    more = written(_likely(rest, distinct, percent), "likely")
    return found.union(written(_checked(docs, distinct, more, width, percent), "links"))


def _hubs(wide: DataFrame, labels: DataFrame, apart_only: bool) -> DataFrame:
    """The members of bands of several labels, with their label, the band's hub and its label as main; of those apart from it only, with a hub of theirs."""
    named = written(salted_join(wide, labels.withColumnRenamed("node", "set"), ["set"], ["band"]), "labelled")
    chosen = F.max(F.struct("meets", -F.col("set"), "label"))
    bands = named.groupBy("band").agg(chosen.alias("hub"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    members = salted_join(named, bands.select("band", F.col("hub.label").alias("main"), (-F.col("hub.col2")).alias("hub")), ["band"], ["set"])
    if not apart_only:
        return members
    rest = members.where("label <> main").drop("main", "hub")
    bands = rest.groupBy("band").agg(chosen.alias("hub"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    return salted_join(rest, bands.select("band", F.col("hub.label").alias("main"), (-F.col("hub.col2")).alias("hub")), ["band"], ["set"])


def _star(wide: DataFrame, labels: DataFrame, apart_only: bool) -> DataFrame:
    """Pairs (a, b) of a band's hub and the members of other labels."""
    pairs = _hubs(wide, labels, apart_only).where("label <> main")
    return written(pairs.select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct(), "band-pairs")


def _checked(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that are similar on their whole sets."""
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    sets = sets_of(docs, distinct.join(wanted, "set", "left_semi").select("doc_id"), width)
    return verified(pairs, sets, percent)


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (it is that one).

    Linked: 100 |A and B| >= percent |A or B| for the sets of word shingles, checked on whole sets. Words are cut at space and the controls 9 to 13,
    A-Z lower-cased; a text of fewer words than width is one shingle. A null or empty text, or one without words, has no
    shingles, is linked with nothing and kept. Equal rows stay and share a component; a null doc_id is never the
    smallest unless it is the only one, and such a row is kept if its component has no other.
    """
    sketched = written(sketches(docs, width), "sketches")
    found = components(links(docs, sketched, width, percent))
    firsts = sketched.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("first"))
    named = firsts.join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    per_set = salted_join(named, smallest, ["label"], ["set"]).select("set", "component_id")
    rows = salted_join(sketched.select("doc_id", "n", "set"), per_set, ["set"], ["doc_id"], "left")
    component: Column = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
