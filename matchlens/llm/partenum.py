"""N-gram Jaccard join by PartEnum signatures.

Sets are dealt to bands of sizes so that similar sets are in one band or in two that touch. In a band of sizes up to r, similar sets differ in
k = 2 r (1 - t) / (1 + t) elements at most. The domain of shingles is cut into n1 parts of which one has at most k2 of these
differences, and each part into n2 pieces of which n2 - k2 are then equal: every choice of n2 - k2 pieces is a signature,
so sets that are similar enough share one. Signatures are sums of scattered shingles, so one pass over the sorted set makes them all.
Long sets have some spare parts, and drop the signatures of choices without any shingle if these lie in no more parts than spare ones:
one of either of two such sets is then enough to share a signature with content.

A group of sets that share a signature isn't expanded into pairs. Its members are compared with one of them (a hub) first;
after connected components are known, only members of different components are compared further.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import free_names, give_back, salted_join, slices, small_ids, until_end, written
from matchlens.llm.components import components
from matchlens.llm.shingles import forget_words, mixed, shingle_set

WRONG_PIECES = 1


def pieces_of(percent: int) -> int:
    """Pieces of a part: at low similarities parts are small, and two equal pieces of three tell more than one of two."""
    return 2 if percent >= 85 else 3


def bands(most: int, percent: int) -> list[int]:
    """Largest size of each band up to the size `most`: a band's sizes are all similar enough to its smallest."""
    out, low = [0], 1
    while out[-1] < most:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return out


def differences(size: int, percent: int) -> int:
    """How many elements two similar sets of at most `size` elements can differ in."""
    return 2 * size * (100 - percent) // (100 + percent)


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set: those of its own band and of the next, in which smaller sets meet larger ones."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    limits = bands(len(shingles), percent)
    own = len(limits) - 1
    nearest = limits + [(limits[-1] + 1) * 100 // percent]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles))])
    out = []
    for band in (own, own + 1):
        k = differences(nearest[band], percent)
        wrong = min(WRONG_PIECES, k)
        pieces = pieces_of(percent) if wrong else 1
        parts = (k + 1 + wrong) // (wrong + 1)
        spare = parts // 40 + 2 if parts >= 8 else 0
        parts += spare                                   # so of similar sets spare + 1 parts at least have no more wrong pieces
        edges = np.arange(1, parts * pieces, dtype=np.float64) * (2.0 ** 64 / (parts * pieces))
        at = np.concatenate([[0], np.searchsorted(shingles, edges.astype(np.uint64)), [len(shingles)]])
        held, full = (sums[at[1:]] - sums[at[:-1]]).reshape(parts, pieces), np.diff(at).reshape(parts, pieces) > 0
        choices = list(combinations(range(pieces), pieces - wrong))
        bare = np.array([~full[:, c].any(axis=1) for c in choices])
        # Choices without any shingle bring strangers together. A set with these in few parts needs none of them: a spare part is left.
        needless = bare.any(axis=0).sum() <= spare
        for choice, empty in zip(choices, bare, strict=True):
            content = np.full(parts, np.uint64(0))
            for piece in choice:
                content = mixed(content + held[:, piece] + np.uint64(piece + 1))
            code = np.uint64(sum(1 << c for c in choice) + (band << 8))
            made = mixed(content + mixed(np.arange(parts, dtype=np.uint64) * np.uint64(1 << 20) + code))
            out.append(made[~empty] if needless else made)
    return np.unique(np.concatenate(out))


# --- the join ----------------------------------------------------------------------------------------------------------

ENTRIES = 500_000            # signatures of a part, and those that a task holds before it deals them out
MOST_MET = 200_000           # names of sets that a task remembers
BLOCK = 256                  # members of a large group that others are compared with at once
FLAGS = 512                  # bits of a set's parity: their differences count at most the sets' differences
LONG = 1000                  # larger sets have a second parity, of as many bits as shingles at least
_PACKED = "part long, kind int, signatures binary, owners binary, sets binary"
_FOUND = "kind int, doc_id long, set long, n long, flags array<long>, more array<long>, signature long"
_PACKED_ARROW = pa.schema([("part", pa.int64()), ("kind", pa.int32()), ("signatures", pa.binary()), ("owners", pa.binary()), ("sets", pa.binary())])
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("set", pa.int64()), ("n", pa.int64()), ("flags", pa.list_(pa.int64())),
                          ("more", pa.list_(pa.int64())), ("signature", pa.int64())])
_NONE = np.iinfo(np.int64).min
DOCUMENT, LOCAL, FIRST = 0, 1, 2


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit name of the set; 0 for the empty one. Two of N sets share one with chance N^2 / 2^65."""
    if not len(shingles):
        return 0
    return int((mixed(shingles).sum(dtype=np.uint64) ^ mixed(np.array([len(shingles)], np.uint64))[0]).astype(np.int64)) or 1


def parities(shingles: np.ndarray, bits: int = FLAGS) -> np.ndarray:
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).view("<i8")


def long_bits(n: int) -> int:
    """Bits of the second parity: a power of two, so that the longer of two folds to the shorter."""
    return 1 << (n - 1).bit_length() if n > LONG else 0


class _Dealer:
    """Signatures of the documents of one task, dealt to parts. A set that the task met before deals none."""

    def __init__(self, parts: int, percent: int):
        self.parts, self.percent = parts, percent
        self.sets: list[int] = []
        self.lists: list[np.ndarray] = []
        self.documents: list[np.ndarray] = []
        self.longer: list[np.ndarray] = []
        self.met: set[int] = set()
        self.held = self.turns = 0

    def add(self, doc_id: int | None, shingles: np.ndarray) -> None:
        key = set_key(shingles)
        self.documents.append(np.concatenate([np.array([_NONE if doc_id is None else doc_id, key, len(shingles)], "<i8"), parities(shingles)]))
        if len(shingles) > LONG:
            self.longer.append(parities(shingles, long_bits(len(shingles))))
        if len(shingles) and key not in self.met:
            self.met.add(key)
            self.sets.append(key)
            self.lists.append(signatures(shingles, self.percent))
            self.held += len(self.lists[-1])
        self.held += 1

    def _part(self, signature: np.ndarray) -> np.ndarray:
        return (signature % np.uint64(self.parts)).astype(np.int64)

    def rows(self, task: int) -> pa.RecordBatch:
        """Documents as they are; signatures that several sets here share, with all of them; one set for every signature."""
        keys = np.array(self.sets, np.int64)
        owner = np.repeat(np.arange(len(keys)), [len(x) for x in self.lists])
        sig = np.concatenate(self.lists) if self.lists else np.zeros(0, np.uint64)
        order = np.argsort(sig, kind="stable")
        sig, owner = sig[order], owner[order]
        first = np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.zeros(0, bool)
        shared = ~first
        shared[:-1] |= ~first[1:]
        out: dict[str, list] = {c: [] for c in _PACKED_ARROW.names}

        def put(part: int, kind: int, signatures: bytes, owners: bytes, sets: bytes) -> None:
            for name, value in zip(out, (part, kind, signatures, owners, sets), strict=True):
                out[name].append(value)
        apart = self.parts + (task * 7919 + self.turns) % self.parts
        longer = np.concatenate(self.longer) if self.longer else np.zeros(0, "<i8")
        put(apart, DOCUMENT, b"", longer.astype("<i8").tobytes(), np.concatenate(self.documents).tobytes())
        if shared.any():
            named = self._part(sig[shared]).astype("<u8") << np.uint64(32) | sig[shared] >> np.uint64(32)
            put(apart, LOCAL, named.astype("<u8").tobytes(), b"", keys[owner[shared]].astype("<i8").tobytes())
        sig, owner = sig[first], owner[first]
        part = self._part(sig)
        order = np.argsort(part, kind="stable")
        sig, owner, part = sig[order], owner[order], part[order]
        for p, lo, hi in zip(*_runs(part), strict=True):
            mine, numbers = np.unique(owner[lo:hi], return_inverse=True)
            # Four bytes of a signature do inside a part: sets that meet by chance are compared in vain, no more.
            put(int(p), FIRST, (sig[lo:hi] >> np.uint64(32)).astype("<u4").tobytes(), numbers.astype("<u2" if len(mine) <= 65536 else "<u4").tobytes(), keys[mine].astype("<i8").tobytes())
        self.sets, self.lists, self.documents, self.longer, self.held, self.turns = [], [], [], [], 0, self.turns + 1
        if len(self.met) > MOST_MET:
            self.met = set()
        types = dict(zip(_PACKED_ARROW.names, _PACKED_ARROW.types, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(v, types[c]) for c, v in out.items()], schema=_PACKED_ARROW)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)
    return sorted_values[starts], starts, np.r_[starts[1:], len(sorted_values)]


def _rows_of_part(packed: pa.Table) -> Iterator[pa.RecordBatch]:
    """Documents, and (signature, set) of the signatures that several sets of this part share."""
    sigs, sets = [], []

    def members(signature: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
        n = len(key)
        nothing = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), nothing, pa.array(key), nothing, pa.nulls(n, pa.list_(pa.int64())),
                                           pa.nulls(n, pa.list_(pa.int64())), pa.array(signature.astype(np.int64))], schema=_FOUND_ARROW)
    for part, kind, signature, owners, keys in zip(*(packed.column(c) for c in _PACKED_ARROW.names), strict=True):
        part, kind, signature, owners, keys = part.as_py(), kind.as_py(), signature.as_py(), owners.as_py(), np.frombuffer(keys.as_py(), "<i8")
        if kind == DOCUMENT:
            rows = keys.reshape(-1, 3 + FLAGS // 64)
            n = len(rows)
            ends = np.cumsum([long_bits(k) // 64 for k in rows[:, 2].tolist()])
            longer = np.frombuffer(owners, "<i8").tolist()
            more = [longer[a:b] if b > a else None for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.zeros(n, np.int32)), pa.array(rows[:, 0], pa.int64(), mask=rows[:, 0] == _NONE), pa.array(rows[:, 1].copy()),
                pa.array(rows[:, 2].copy()), pa.array(rows[:, 3:].tolist(), pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64())),
                pa.nulls(n, pa.int64())], schema=_FOUND_ARROW)
        elif kind == LOCAL:
            yield members(np.frombuffer(signature, "<u8"), keys)
        else:
            sigs.append(np.frombuffer(signature, "<u4").astype(np.uint64) | np.uint64(part << 32))
            sets.append(keys[np.frombuffer(owners, "<u2" if len(keys) <= 65536 else "<u4")])
    if sigs:
        sig, key = np.concatenate(sigs), np.concatenate(sets)
        order = np.argsort(sig, kind="stable")
        sig, key = sig[order], key[order]
        again = np.r_[False, sig[1:] == sig[:-1]]
        again[:-1] |= again[1:]
        yield members(sig[again], key[again])


def sketches(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, set, n, flags) and members (signature, set) of the signatures that several sets share.

    Only signatures meet in the shuffle, packed by part; a signature that many sets of one task share is sent once, so no part follows
    the size of a group of copies. Parts grow in number with the texts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    letters = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(letters) // (4 * ENTRIES)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer, task = _Dealer(parts, percent), TaskContext.get().partitionId()
        for batch in until_end(slices(batches, "text"), forget_words):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                dealer.add(doc_id, shingle_set(text, width))
                if dealer.held >= ENTRIES:
                    yield dealer.rows(task)
        if dealer.documents:
            yield dealer.rows(task)

    def meet(packed: pa.Table) -> pa.Table:
        give_back()
        return pa.Table.from_batches(list(_rows_of_part(packed)), schema=_FOUND_ARROW)
    found = written(texts.mapInArrow(deal, _PACKED).groupBy("part").applyInArrow(meet, _FOUND), "sketches")
    return (found.where("kind = 0").select("doc_id", "set", "n", "flags", "more"),
            found.where("kind = 1").select("signature", "set").distinct())


def possible(percent: int, a: str, b: str) -> Column:
    """Sizes and parities allow the similarity: a pair that fails can't be similar."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.bit_count(F.col(f"{a}.f0").bitwiseXOR(F.col(f"{b}.f0"))).cast("long")
    for k in range(1, FLAGS // 64):
        apart = apart + F.bit_count(F.col(f"{a}.f{k}").bitwiseXOR(F.col(f"{b}.f{k}")))
    allowed = (n_a + n_b) * (100 - percent)
    likely = (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (apart * (100 + percent) <= allowed)
    more_a, more_b = F.col(f"{a}.more"), F.col(f"{b}.more")
    short = F.least(F.size(more_a), F.size(more_b))

    def folded(x: Column) -> Column:
        half = F.zip_with(F.slice(x, F.lit(1), short), F.slice(x, short + 1, short), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > short, half).otherwise(x)
    far = F.aggregate(F.zip_with(folded(more_a), folded(more_b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)
    both = more_a.isNotNull() & more_b.isNotNull()
    return likely & (~both | (far.cast("long") * (100 + percent) <= allowed))


PAIRS = 1024                 # pairs that one copy of a set serves


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 |A and B| >= percent |A or B|.

    Set a may be that of very many pairs: it is sent once for every PAIRS of them, and no broadcast takes these copies for one.
    """
    pairs = written(pairs, "pairs")
    fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts"))
    dealt = salted_join(pairs, fan, ["a"], ["b"]).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    of_a = sets.join(fan, sets["set"] == fan["a"]).select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("shingles").alias("of_a")).hint("merge")
    both = dealt.join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("of_b")), "b").join(of_a, ["a", "part"])
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return both.where(common * 100 >= union * percent).select("a", "b")


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """set and shingles of the documents wanted (doc_id); a repeated doc_id may bring sets of other texts, which nobody asks for."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in until_end(slices(batches, "text"), forget_words):
            found = {}
            for text in batch.column("text").to_pylist():
                shingles = shingle_set(text, width)
                found[set_key(shingles)] = shingles.astype(np.int64)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))],
                                                 ["set", "shingles"])
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    wanted = small_ids(wanted.select("doc_id"), "wanted")
    joined = texts.join(wanted, texts["_doc"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
    return written(joined.mapInArrow(build, "set long, shingles array<long>").dropDuplicates(["set"]), "sets")


def links(docs: DataFrame, documents: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between sets which connect all that similar sets connect."""
    flags = [F.col("flags")[k].alias(f"f{k}") for k in range(FLAGS // 64)]
    distinct = documents.where("n > 0").groupBy("set").agg(F.min("n").alias("n"), F.min("flags").alias("flags"), F.min("more").alias("more"),
                                                                F.min("doc_id").alias("doc_id"))
    distinct = written(distinct.select("set", "n", "doc_id", "more", *flags), "distinct-sets")
    columns = ["n", "more", *(f"f{k}" for k in range(FLAGS // 64))]
    # Close copies share most of their signatures: of groups with the same members one is enough.
    members = written(members, "signature-members")
    groups = members.groupBy("signature").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("set")).alias("who"),
                                              F.bit_xor(F.xxhash64("set", F.lit(1))).alias("again")).where("m > 1")
    groups = groups.groupBy("m", "who", "again").agg(F.min("signature").alias("signature")).select("signature", "m")
    wide = salted_join(members, written(groups, "groups"), ["signature"], ["set"]).join(distinct.drop("doc_id"), "set")
    wide = wide.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    wide = written(wide.drop("m"), "members")
    # Only sets with a possible partner go on; first in the own block, then, in groups of several blocks, in the others.
    same = (F.col("a.signature") == F.col("b.signature")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.set") != F.col("b.set"))
    # Parquet stores what a set repeats for each of its signatures once: rows of that size would be broadcast at many times its files' size.
    hopeful = written(wide.alias("a").join(wide.alias("b").hint("merge"), same & possible(percent, "a", "b"), "left_semi").select("set").distinct(), "hopeful")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rest = wide.where("blocks > 1").join(hopeful, "set", "left_anti").withColumn("block", every)
    more = rest.alias("a").join(wide.where("blocks > 1").alias("b").hint("merge"), same & possible(percent, "a", "b"), "left_semi").select("set").distinct()
    hopeful = written(hopeful.union(more), "hopeful")
    wide = written(wide.join(hopeful, "set", "left_semi"), "hopeful-members")
    sets = sets_of(docs, distinct.join(hopeful, "set", "left_semi").select("doc_id"), width)
    # Every member against the group's smallest set.
    hub = wide.groupBy("signature").agg(F.min("set").alias("a"))
    near = salted_join(wide.select("signature", F.col("set").alias("b")), hub, ["signature"], ["b"]).where("a <> b").select("a", "b")
    near = written(near.distinct(), "near")
    own = distinct.drop("doc_id").join(hopeful, "set", "left_semi")
    for side in ("a", "b"):
        near = near.join(own.select(F.col("set").alias(side), F.struct(*columns).alias(f"of_{side}")), side)
    first = written(verified(near.where(possible(percent, "of_a", "of_b")).select("a", "b"), sets, percent), "links")
    # Members whose component isn't that of the hub, against those of all other components.
    labels = components(first)
    marked = wide.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    marked = written(marked, "marked")
    main = marked.groupBy("signature").agg(F.min(F.struct("set", "label")).alias("hub")).select("signature", F.col("hub.label").alias("main"))
    others = salted_join(marked, main, ["signature"], ["set"]).where("label <> main").withColumn("block", every)
    left = others.alias("a").join(marked.alias("b").hint("merge"), (F.col("a.signature") == F.col("b.signature")) & (F.col("a.block") == F.col("b.block"))
                                  & (F.col("a.label") != F.col("b.label")) & possible(percent, "a", "b"))
    pairs = left.select(F.least("a.set", "b.set").alias("a"), F.greatest("a.set", "b.set").alias("b")).distinct()
    return first.union(written(verified(pairs, sets, percent), "links"))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links of similar sets reach).

    Similar: 100 |A and B| >= percent |A or B|, checked on whole sets of 64-bit shingle hashes. Words are cut at space and the controls 9 to
    13, A-Z lower-cased; a text of fewer words than width is one shingle. A null or empty text, or one without words, has none
    and is linked with nothing. Equal rows stay and share a component; a null doc_id is never the smallest unless it is the only one.
    """
    documents, members = sketches(docs, width, percent)
    found = components(links(docs, documents, members, width, percent))
    firsts = documents.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("first"))
    named = firsts.join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    smallest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    per_set = salted_join(named, smallest, ["label"], ["set"]).select("set", "component_id")
    rows = salted_join(documents.select("doc_id", "n", "set"), per_set, ["set"], ["doc_id"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def without_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows, with all their columns, but for those whose component has a smaller doc_id. Texts without words all stay.

    Repeated rows of the smallest doc_id of a component all stay if their doc_id is equal.
    """
    found = jaccard_components(docs, width, percent).where("component_id < doc_id")
    name, = free_names(docs, "gone")
    gone = small_ids(found.select(F.col("doc_id").alias(name)), "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone[name], "left_anti")
