"""Spelling variants by search schemes on bidirectional FM-indexes.

Two words with one error between them agree in the first or in the last half of either. The scheme has two searches: match the first
half exactly and extend to the right over the second with one error, or match the second half and extend to the left. Each needs
the direction in which it extends, so the index to the right holds the words, the one to the left their reverses; no search
turns round. States are intervals of suffix ranks; an extension by a letter is one look-up in the sorted occurrences of letters in the
Burrows-Wheeler transform, for all states of a step at once.

The vocabulary is cut into shards of bounded size. Words of six letters or more share the first or the last three of them with every word
one error away, so a shard holds all words of some beginnings (or endings), and a word meets one shard for each direction. A beginning with
more words than a shard takes is cut into blocks, and all its words are looked up in each, blocks of words at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlens.llm.common import LOWER, UPPER, slices, small_rows, written

ERRORS_EVERY = 31            # of the hashes of occurrences, one in so many loses a letter
LEAST_LETTERS = 7
LEAST_COUNT = 2
LARGER = 10                  # times a word's count that of its form is at least
ANCHOR = 3                   # letters at an end that words one error apart share: half of LEAST_LETTERS
SHARD = 1 << 16              # words of an index
HELD = 200_000               # words that a task counts before it passes them on
STATES = 1 << 20             # states that are extended at once
_RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans(UPPER, LOWER)


# --- the vocabulary ---------------------------------------------------------------------------------------------------


def spelled(doc_id: int | None, run: str) -> str:
    """The lower-cased run as it counts in the document: without one letter if its hash says so. A null doc_id is written as nothing."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % ERRORS_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n: the words of LEAST_LETTERS letters or more that occur LEAST_COUNT times in all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own: dict[str, int] = {}
                for run in _RUNS.findall(text or ""):
                    if len(run) >= LEAST_LETTERS:
                        own[run] = own.get(run, 0) + 1
                for run, n in own.items():
                    word = spelled(doc_id, run.translate(_LOWER))
                    if len(word) >= LEAST_LETTERS:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield _counted(held)
                    held = {}
        yield _counted(held)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _counted(held: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


# --- the index --------------------------------------------------------------------------------------------------------


class Index:
    """FM-index of the text $w1$w2$...$ of distinct words, each read backwards: a search extends to the right, letter by letter.

    Letters are numbers from 1, the delimiter is 0. Delimiters are ordered by the word behind them (the last one, without a word, first),
    and the words so that their reverses ascend: then suffixes that start with a delimiter are in the order of what follows.
    """

    def __init__(self, letters: np.ndarray, starts: np.ndarray):
        """Word k is letters[starts[k]:starts[k + 1]], the reverses in ascending order."""
        n_words, lengths = len(starts) - 1, np.diff(starts)
        self.size = len(letters) + n_words + 1
        self.at = np.concatenate([[0], np.cumsum(lengths + 1)])              # of the delimiters
        text = np.zeros(self.size, np.int64)
        place = np.arange(len(letters)) - np.repeat(starts[:-1], lengths)
        text[np.repeat(self.at[1:], lengths) - 1 - place] = letters
        self.letters = int(letters.max(initial=0)) + 1
        self.order = _suffixes(text, self.at)
        before = text[self.order - 1]                                        # the transform; text[-1] is a delimiter as well
        occurrences = np.argsort(before, kind="stable")
        self.before = before
        self.occurrences = before[occurrences] * (self.size + 1) + occurrences

    def extend(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the words that go on with the letter."""
        base = letter * (self.size + 1)
        return np.searchsorted(self.occurrences, base + low), np.searchsorted(self.occurrences, base + high)

    def going_on(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the interval and letter, for all letters (not the delimiter) by which disjoint intervals go on."""
        lengths = high - low
        which = np.repeat(np.arange(len(low)), lengths)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + low[which]
        found = np.unique(which * self.letters + self.before[rows])
        which, letter = found // self.letters, found % self.letters
        return which[letter > 0], letter[letter > 0]

    def words(self, low: np.ndarray) -> np.ndarray:
        """The word between the delimiters of an interval."""
        return np.searchsorted(self.at, self.order[low])


def _suffixes(text: np.ndarray, delimiters: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling: ranks by the first 2, 4, 8 ... letters, delimiters being different from each other."""
    n = len(text)
    rank = text + len(delimiters)
    rank[delimiters] = (np.arange(len(delimiters)) + 1) % len(delimiters)
    ahead = 1
    while True:
        following = np.zeros(n, np.int64)
        following[:n - ahead] = rank[ahead:] + 1
        key = rank * (max(int(rank.max()), n) + 2) + following
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        ahead *= 2
        if ahead >= n:
            raise ArithmeticError("words are not distinct")


def _coded(words: list[str], backwards: bool, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters as numbers from 1, word after word, and where each begins."""
    joined = "".join(w[::-1] for w in words) if backwards else "".join(words)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    return np.searchsorted(alphabet, points) + 1, starts


def near_words(words: list[str], queries: list[str], backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of queries and of distinct words that are one error apart, the error in the query's second half (backwards: in its first).

    A pair may come twice, and where equal letters stand beside each other it may come from an error in the other half.
    """
    if not words or not queries:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The index needs the reverses of what it reads in ascending order.
    order = sorted(range(len(words)), key=(lambda k: words[k]) if backwards else (lambda k: words[k][::-1]))
    alphabet = np.unique(np.frombuffer("".join([*words, *queries]).encode("utf-32-le"), "<u4"))
    index = Index(*_coded([words[k] for k in order], backwards, alphabet))
    letters, starts = _coded(queries, backwards, alphabet)
    found = list(_search(index, letters, starts, [(len(q) + backwards) // 2 for q in queries]))
    who = np.concatenate([w for w, _ in found]) if found else np.zeros(0, np.int64)
    whom = np.array(order)[np.concatenate([w for _, w in found])] if found else np.zeros(0, np.int64)
    return who, whom


def _search(index: Index, letters: np.ndarray, starts: np.ndarray, halves: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths, half = np.diff(starts), np.array(halves)
    n = len(lengths)
    who = np.arange(n)
    low, high = index.extend(np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, index.size))
    for place in range(int(lengths.max()) + 1):
        alive = (lengths[who] >= place) & (high > low)
        who, low, high = who[alive], low[alive], high[alive]
        if not len(who):
            return
        ready = half[who] <= place
        mine, at_low, at_high = who[ready], low[ready], high[ready]
        more = lengths[mine] > place
        # A letter of the query that the word doesn't have.
        yield from _finish(index, letters, starts, mine[more], at_low[more], at_high[more], place + 1)
        # Another letter of the word, in place of the query's or before it. Intervals of one step are equal or disjoint.
        unique, which = np.unique(at_low, return_inverse=True)
        ends = np.zeros(len(unique), np.int64)
        ends[which] = at_high
        node, letter = index.going_on(unique, ends)
        first, count = np.searchsorted(node, np.arange(len(unique))), np.bincount(node, minlength=len(unique))
        for part in _parts(count[which]):
            children = count[which[part]]
            each = np.repeat(np.arange(part.start, part.stop), children)
            child = np.arange(len(each)) - np.repeat(np.cumsum(children) - children, children) + first[which[each]]
            own = np.where(more[each], letters[np.minimum(starts[mine[each]] + place, len(letters) - 1)], 0)
            each, child = each[letter[child] != own], child[letter[child] != own]
            by_low, by_high = index.extend(letter[child], at_low[each], at_high[each])
            instead = more[each]
            yield from _finish(index, letters, starts, mine[each[instead]], by_low[instead], by_high[instead], place + 1)
            yield from _finish(index, letters, starts, mine[each], by_low, by_high, place)
        further = lengths[who] > place
        who, low, high = who[further], low[further], high[further]
        low, high = index.extend(letters[starts[who] + place], low, high)


def _parts(counts: np.ndarray) -> Iterator[slice]:
    """Ranges of the counts that sum up to about STATES."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STATES, "right")))
        yield slice(at, to)
        at = to


def _finish(index: Index, letters: np.ndarray, starts: np.ndarray, who: np.ndarray, low: np.ndarray, high: np.ndarray,
            place: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """States without an error left: the rest of the query from the place on, and a delimiter."""
    while len(who):
        alive = high > low
        who, low, high = who[alive], low[alive], high[alive]
        inside = starts[who] + place < starts[who + 1]
        ended = ~inside
        if ended.any():
            at, to = index.extend(np.zeros(int(ended.sum()), np.int64), low[ended], high[ended])
            yield who[ended][to > at], index.words(at[to > at])
        who, low, high = who[inside], low[inside], high[inside]
        low, high = index.extend(letters[starts[who] + place], low, high)
        place += 1


# --- Spark --------------------------------------------------------------------------------------------------------------------


def _shards(words: DataFrame, backwards: bool) -> DataFrame:
    """The words (id, word, n) with shard and kind: 0 in the index, 1 looked up in it. Kind 1 comes once for every block of a shard's index."""
    anchor = F.substring("word", -ANCHOR, ANCHOR) if backwards else F.substring("word", 1, ANCHOR)
    anchored = words.withColumn("anchor", anchor)
    n = words.count()
    many = max(1, -(-2 * n // SHARD))
    # Few anchors can have more words than half a shard.
    hot = small_rows(written(anchored.groupBy("anchor").count().where(F.col("count") > SHARD // 2).select(
        "anchor", F.ceil(F.col("count") / (SHARD // 2)).cast("int").alias("blocks")), "hot-anchors"))
    blocked = anchored.join(hot, "anchor", "left")
    usual = blocked.where("blocks is null").withColumn("shard", F.concat_ws("|", F.pmod(F.xxhash64("anchor"), F.lit(many))))
    split = blocked.where("blocks is not null").withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def named(index_block: Column, query_block: Column) -> Column:
        return F.concat_ws("|", "anchor", index_block, query_block).alias("shard")
    split = split.withColumn("other", every)
    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("kind")
    return usual.select("shard", both, "id", "word", "n").unionByName(
        split.select(named(F.col("mine"), F.col("other")), F.lit(0).alias("kind"), "id", "word", "n")).unionByName(
        split.select(named(F.col("other"), F.col("mine")), F.lit(1).alias("kind"), "id", "word", "n"))


def near_pairs(words: DataFrame) -> DataFrame:
    """id and near_id with near_n: all ordered pairs of words (id, word, n) that are one error apart."""
    def pairs(backwards: bool) -> DataFrame:
        def search(shard: pa.Table) -> pa.Table:
            kind = shard.column("kind").to_numpy()
            index, queries = shard.filter(pa.array(kind == 0)), shard.filter(pa.array(kind == 1))
            who, whom = near_words(index.column("word").to_pylist(), queries.column("word").to_pylist(), backwards)
            own, near = queries.column("id").to_numpy()[who], index.column("id").to_numpy()[whom]
            return pa.table({"id": own, "near_id": near, "near_n": index.column("n").to_numpy()[whom]}).filter(pa.array(own != near))
        return _shards(words, backwards).groupBy("shard").applyInArrow(search, "id long, near_id long, near_n long")
    return pairs(False).unionByName(pairs(True)).distinct()


def spelling_forms(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary of docs (doc_id, text).

    Words are lower-cased runs of letters (A-Z, U+00C0 to U+00FF) as `spelled` has them. Words are near if they differ by exactly one inserted,
    deleted or replaced code point. A word's form is its near word of the largest n (ties: the smallest by code points) if that is LARGER times
    its own at least, else null; root follows forms to the last one. Null and empty texts have no words; repeated rows
    count as often as they stand there; no words: no rows.
    """
    # Ids ascend with the words, so that ties are decided by ids.
    words = written(vocabulary(docs).sort("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")
    best = F.max(F.struct(F.col("near_n"), (-F.col("near_id")).alias("minus")))
    near = near_pairs(words).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = words.join(near, "id", "left")
    large = F.col("best.near_n") >= F.col("n") * LARGER
    found = written(joined.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                  F.when(large, -F.col("best.minus")).alias("form_id"), F.when(large, F.col("best.near_n")).alias("form_n")), "forms")
    # Counts grow LARGER times with every step, so chains are short; each round doubles the steps.
    roots = found.where("form_id is not null").select("id", F.col("form_id").alias("root_id"))
    while True:
        further = roots.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        step = written(roots.join(further, "root_id", "left").select("id", F.coalesce("next", "root_id").alias("root_id"),
                                                                      F.col("next").isNotNull().alias("moved")), "roots")
        roots = step.select("id", "root_id")
        if step.where("moved").limit(1).count() == 0:
            break
    names = words.select("id", "word")
    form = names.select(F.col("id").alias("form_id"), F.col("word").alias("form"))
    root = roots.join(names.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "root")
    return found.join(form, "form_id", "left").join(root, "id", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
