"""Interpolated modified Kneser-Ney over word trigrams, per language, with counts and look-ups that stay sharded.

Every token is kept as it is (in lower case) and named by 64 bits of its language and letters. The log probability of a text is a sum of one value
for each of its grams that trusted text has: value(gram) is what the gram changes against its shorter gram, and the weight it leaves to shorter
grams as a context. All of these but a word's own probability belong to the middle word of a trigram. So trigrams travel packed to shards by their
middle word, which count the trusted ones and score the others, and only sums by text come back. To keep what is on disk at once below the input,
shards are done in several passes over the texts, each of which frees its shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlens.llm.common import BATCH_BYTES, give_back, new_path, removed, slices

HOT_SHARE = 50               # a middle word with more than this part of all tokens goes to SPREAD shards
SPREAD = 4
PASSES = 3
SHARD = 4_000_000            # trigrams of a shard, about
LEAST_SHARDS = 8
SLICE = 12 << 20             # bytes of text that are packed at once
POOLED = ""
START, END = np.uint64(1), np.uint64(2)
# Scripts without spaces give a token for each letter.
_ALONE = r"฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
_MARKS = r"̀-֑ͯ-ׇً-ٟऀ-෿"
_WORD = rf"(?:(?![{_ALONE}])[\w{_MARKS}])+"
_TOKEN = re.compile(rf"\n|[{_ALONE}]|{_WORD}|\S")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of about SLICE bytes of text, from batches of any size."""
    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    held, size = [], 0
    for batch in slices(batches, "text", SLICE):
        held.append(batch)
        size += batch.nbytes
        if size > SLICE - SLICE // 8:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: 0 between tokens, 1 a token of its own, 2 part of a word; and its random number."""
    every = "".join(map(chr, range(0x110000)))
    kind = np.ones(len(every), np.uint8)
    for value, of in ((0, r"\s+"), (2, _WORD), (1, rf"[{_ALONE}]+|\n")):
        for found in re.finditer(of, every):
            kind[found.start():found.end()] = value
    return kind, _mix(np.arange(1, len(every) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0xD1342543DE82EF95
_CHUNK = 1 << 16


@cache
def _powers(letters: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.full(letters, x, np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _named(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The names of the tokens of texts in lower case, one text after the other, and their number in each."""
    kind_of, number_of = _letters()
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) for x in texts])
    kind = kind_of[letters]
    fresh = np.ones(len(letters) + 1, bool)
    fresh[1:-1] = (kind[1:] != 2) | (kind[:-1] != 2)
    fresh[ends] = True
    start = np.flatnonzero(fresh)
    start, end = start[:-1], start[1:]
    kept = kind[start] > 0
    start, end = start[kept], end[kept]
    # A token's name is a polynomial in _BASE of its letters' numbers, from running sums over all letters.
    powers, back = _powers(2 * _CHUNK) if len(letters) <= 2 * _CHUNK else _powers.__wrapped__(len(letters))
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(number_of[letters] * powers[:len(letters)], out=sums[1:])
    names = _mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    return names, np.diff(np.searchsorted(start, np.concatenate([[0], ends])))


def names(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    found, own, held = [(np.array([], np.uint64), np.array([], np.int64))], [], 0
    for text in texts:
        own.append((text or "").lower())
        held += len(own[-1])
        if held > _CHUNK:
            found.append(_named(own))
            own, held = [], 0
    if own:
        found.append(_named(own))
    return np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])


def _seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


class Laid:
    """The words of texts under a language each, with START twice before and END behind each text."""

    def __init__(self, texts: list[str | None], langs: list[str]) -> None:
        found, self.tokens = names(texts)
        size = self.tokens + 3
        begin = np.cumsum(size) - size
        every = np.arange(len(texts))
        self.text = np.repeat(every, size)
        word = np.empty(len(self.text), np.uint64)
        word[begin] = word[begin + 1] = START
        word[begin + size - 1] = END
        word[np.arange(len(found)) + 3 * np.repeat(every, self.tokens) + 2] = found
        seeds = {x: _seed(x) for x in set(langs)}
        self.word = _mix(word + np.array([seeds[x] for x in langs], np.uint64)[self.text]) if len(texts) else word
        #: Where a trigram ends.
        self.full = np.flatnonzero(np.arange(len(word)) - np.repeat(begin, size) >= 2)

    def times(self, own: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """How often a text has the middle word, the first and the last pair and the trigram of those at these places, for own texts; else 0.

        The places have all trigrams that begin with the same pair, or none.
        """
        salt = self.text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        every, some = self.full[own[self.text[self.full]]], np.flatnonzero(own[self.text[at]])
        back = lambda at, k: self.word[at - k]
        here = at[some]
        first = _pair(back(here, 2), back(here, 1))
        found = []
        for key in (back(every, 1), first, _pair(back(every, 1), back(every, 0)), _pair(first, back(here, 0))):
            whole = len(key) == len(every) and len(found) in (0, 2)
            codes = pd.factorize(_mix(key + salt[every if whole else here]))[0]
            times = np.bincount(codes)[codes] if len(codes) else codes
            n = np.zeros(len(self.word), np.uint32) if whole else np.zeros(len(at), np.uint32)
            n[every if whole else some] = times
            found.append(n[at] if whole else n)
        return found


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(_mix(a * np.uint64(3)) + b)


def _shard(word: np.ndarray, other: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a word; a hot one goes to SPREAD of them, by another word."""
    salted = word.copy()
    at = np.flatnonzero(_among(hot, word))
    salted[at] += (other[at] >> np.uint64(40)) % np.uint64(SPREAD) * np.uint64(0x9E3779B97F4A7C15)
    return ((_mix(salted) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each is one of a few keys."""
    bits = np.uint64((1 << 16) - 1)
    some = np.zeros(1 << 16, bool)
    some[keys & bits] = True
    found = some[wanted & bits]
    at = np.flatnonzero(found)
    found[at] = np.isin(wanted[at], keys)
    return found


def _packed(words: list[np.ndarray], numbers: list[np.ndarray]) -> bytes:
    """Arrays of equal length: each different word once, then codes and numbers by their bytes, as most of these are zero."""
    codes, own = pd.factorize(np.concatenate(words))
    columns = [*np.split(codes, len(words)), *numbers]
    planes = [np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for x in columns]
    raw = b"".join([np.array([len(own), len(words[0])], np.int64).tobytes(), own.astype(np.uint64).tobytes(), *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: pa.Buffer, words: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The different words, the arrays' places in these, and the numbers."""
    raw = np.frombuffer(pa.decompress(blob.slice(8), int.from_bytes(blob.slice(0, 8), "little"), "zstd"), np.uint8)
    kinds, rows = raw[:16].view(np.int64).tolist()
    own = raw[16:16 + 8 * kinds].view(np.uint64)
    planes = raw[16 + 8 * kinds:].reshape(-1, 4, rows)
    columns = [np.ascontiguousarray(x.T).view(np.uint32).ravel() for x in planes]
    return own, columns[:words], columns[words:]


def _blobs(table: pa.Table) -> Iterator[pa.Buffer]:
    return (x.as_buffer() for x in table["blob"])


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each key, the groups' keys, and where each occurs first."""
    codes, own = pd.factorize(key)
    first = np.empty(len(own), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, own.astype(np.uint64), first


def _runs(ordered: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal numbers begins and ends."""
    edges = np.flatnonzero(np.diff(ordered, prepend=-1, append=-1)).tolist()
    return list(zip(edges, edges[1:], strict=False))


#: Rows between tasks. shard, kind and blob: packed rows; langs names the languages in it, row its texts. level, lang, key, c, n: statistics.
_ROWS = "shard int, kind int, langs array<string>, row array<long>, blob binary, level int, lang string, key long, c long, n long"
_TYPES = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("langs", pa.list_(pa.string())), ("row", pa.list_(pa.int64())), ("blob", pa.binary()),
                    ("level", pa.int32()), ("lang", pa.string()), ("key", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])
_TRIGRAMS, _PAIRS, _WORDS = 0, 1, 2


def _measured(docs: DataFrame, share: int) -> DataFrame:
    """row, model, trusted and tokens of each text; key and n of tokens that are frequent in some slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found, tokens = names(batch.column("text").to_pylist())
            # A frequent word makes the number of its last bits frequent; START comes once a text.
            last = (found & np.uint64(0xFFFF)).astype(np.int64)
            some = found[(np.bincount(last, minlength=1 << 16) * share > len(found))[last]]
            own, n = np.unique(np.concatenate([some, np.repeat(START, batch.num_rows)]), return_counts=True)
            often = np.flatnonzero(n * share > len(found) + batch.num_rows)
            columns = [batch.column("row"), batch.column("model"), batch.column("trusted"), pa.array(tokens + 1, pa.int64())]
            more = [pa.array(own[often].view(np.int64)), pa.array(n[often], pa.int64())]
            columns = [pa.concat_arrays([x, pa.nulls(len(often), x.type)]) for x in columns] + [pa.concat_arrays([pa.nulls(batch.num_rows, x.type), x]) for x in more]
            yield pa.RecordBatch.from_arrays(columns, ["row", "model", "trusted", "tokens", "key", "n"])
    return docs.select("row", "model", "trusted", "text").mapInArrow(run, "row long, model string, trusted boolean, tokens long, key long, n long")


def _sent(docs: DataFrame, pooled: bool, hot: np.ndarray, shards: int, turn: int | None) -> DataFrame:
    """Packed trigrams of all texts to the shards of this turn by their middle word; turn None: of trusted texts to shards by their last word."""
    passes = PASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts, langs, own = (batch.column(x).to_pylist() for x in ("text", "model", "trusted"))
            k = len(texts)
            if pooled:                                   # trusted texts count for the pooled model as well; that copy isn't scored
                more = [j for j in range(k) if own[j] and langs[j] != POOLED]
                texts, langs, own = texts + [texts[j] for j in more], langs + [POOLED] * len(more), own + [True] * len(more)
            laid = Laid(texts, langs)
            known = sorted(set(langs))
            lang = np.array([known.index(x) for x in langs], np.int64)
            at, word = laid.full, laid.word
            if turn is None:
                shard = _shard(word[at], word[at - 1], hot, shards)
                numbers = []
            else:
                shard = _shard(word[at - 1], word[at - 2], hot, shards)
                kept = shard % passes == turn
                at, shard = at[kept], shard[kept]
                numbers = [np.minimum(laid.text[at], k), *laid.times(np.array(own, bool), at)]
            numbers = [lang[laid.text[at]], *numbers]
            order = np.argsort(shard.astype(np.uint16) if shards < 1 << 16 else shard, kind="stable")
            at, shard, numbers = at[order], shard[order], [x[order] for x in numbers]
            rows = batch.column("row") if turn is not None else None
            for a, b in _runs(shard):
                blob = _packed([word[at[a:b] - 1], word[at[a:b] - 2], word[at[a:b]]], [x[a:b] for x in numbers])
                row = pa.array([rows.to_pylist() if rows is not None else None], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict({
                    "shard": [int(shard[a])], "kind": [_TRIGRAMS], "langs": [known], "row": row, "blob": [blob],
                    **{x: [None] for x in ("level", "lang", "key", "c", "n")}}, _TYPES)
    used = docs if turn is not None else docs.where("trusted")
    return used.select("row", "model", "text", "trusted").mapInArrow(run, _ROWS)


class _Languages(dict):
    """Numbers of languages, given as they come."""

    def __missing__(self, lang: str) -> int:
        self[lang] = len(self)
        return self[lang]

    def of(self, langs: list[str], local: np.ndarray) -> np.ndarray:
        return np.array([self[x] for x in langs], np.int64)[local]


def _counted(sent: DataFrame, hot: np.ndarray, shards: int) -> DataFrame:
    """From the trusted trigrams by last word: numbers of grams by their counts, and for the shards by middle word what doesn't belong to that word:
    of each last word the number of words before it, and the pairs of hot words, which several shards hold.
    """
    def count(table: pa.Table) -> pa.Table:
        ids, parts, out = _Languages(), [], []
        for langs, blob in zip(table["langs"].to_pylist(), _blobs(table), strict=True):
            own, codes, (lang,) = _unpacked(blob, 3)
            parts.append([*(own[x] for x in codes), ids.of(langs, lang)])
        middle, before, last, lang = (np.concatenate(x) for x in zip(*parts, strict=True))
        names = list(ids)

        def statistics(level: int, lang: np.ndarray, c: np.ndarray) -> None:
            for x, n in zip(*(y.tolist() for y in np.unique(c * len(names) + lang, return_counts=True)), strict=True):
                out.append({"level": level, "lang": names[x % len(names)], "c": x // len(names), "n": n})
        codes, _, first = _grouped(_pair(_pair(before, middle), last))
        n = np.bincount(codes)
        middle, last, lang = middle[first], last[first], lang[first]
        statistics(3, lang, n)
        codes, _, first = _grouped(_pair(middle, last))
        c2, raw = np.bincount(codes), np.bincount(codes, n).astype(np.int64)
        middle, last, lang = middle[first], last[first], lang[first]
        statistics(2, lang, c2)
        codes, word, first = _grouped(last)
        c1, often = np.bincount(codes), _among(hot, word)
        statistics(1, lang[first][~often], c1[~often])
        for j in np.flatnonzero(often):
            out.append({"level": 0, "lang": names[lang[first[j]]], "key": int(word[j].view(np.int64)), "c": int(c1[j]), "n": int(raw[codes == j].sum())})

        # A word's number goes where it is a middle word, and where it follows one.
        each = np.arange(SPREAD, dtype=np.uint64) << np.uint64(40)
        copied = np.where(_among(hot, middle), SPREAD, 1)
        entry = np.repeat(np.arange(len(middle)), copied)
        salt = each[np.arange(len(entry)) - np.repeat(np.cumsum(copied) - copied, copied)]
        to = _shard(middle[entry], salt, hot, shards)
        needed = ~often[codes[entry]]
        own = np.flatnonzero(~often)
        shard = np.concatenate([to[needed], _shard(word[own], word[own], hot, shards)])
        which = np.concatenate([codes[entry][needed], own])
        both = np.unique(shard * len(word) + which) if len(word) else np.array([], np.int64)
        shard, which = both // max(len(word), 1), both % max(len(word), 1)
        for a, b in _runs(shard):
            out.append({"shard": int(shard[a]), "kind": _WORDS, "blob": _packed([word[which[a:b]]], [c1[which[a:b]]])})
        spread = copied[entry] > 1
        entry, to = entry[spread], to[spread]
        for x in np.unique(to).tolist():
            at = np.unique(entry[to == x])
            out.append({"shard": x, "kind": _PAIRS, "langs": names, "blob": _packed([middle[at], last[at]], [lang[at], c2[at], raw[at]])})
        return pa.Table.from_pylist(out, _TYPES)
    return sent.groupBy("shard").applyInArrow(count, _ROWS)


def _cuts(counts: dict[int, int]) -> list[float]:
    """The discounts of one size, from the numbers of grams by count."""
    n = [counts.get(k, 0) for k in range(5)]
    if not n[1] + 2 * n[2]:
        return [0.0] * 4
    y = n[1] / (n[1] + 2 * n[2])
    return [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.0), float(k)) if n[k] else 0.0 for k in (1, 2, 3))]


def _cut(cuts: np.ndarray, lang: np.ndarray, c: np.ndarray) -> np.ndarray:
    """What each count loses: never more than it has, so no share is negative."""
    return np.minimum(cuts[lang, np.minimum(c, 3)], c)


def _scored(sent: DataFrame, model: dict[str, tuple], hot: np.ndarray, hot_c1: np.ndarray) -> DataFrame:
    """row and total: the sums of values of the trigrams in a shard, of each text."""
    def score(table: pa.Table) -> pa.Table:
        kinds, langs = table["kind"].to_pylist(), table["langs"].to_pylist()
        ids, parts, given, words = _Languages(), [], [], [(np.array([], np.uint64), np.array([], np.int64))]
        for kind, blob, known in zip(kinds, _blobs(table), langs, strict=True):
            own, codes, numbers = _unpacked(blob, 1 + (kind == _PAIRS) + 2 * (kind == _TRIGRAMS))
            if kind == _TRIGRAMS:
                used = np.flatnonzero(numbers[2])
                if len(used):
                    parts.append([*(own[x[used]] for x in codes), ids.of(known, numbers[0][used])])
            elif kind == _PAIRS:
                given.append([*(own[x] for x in codes), ids.of(known, numbers[0]), *(x.astype(np.int64) for x in numbers[1:])])
            else:
                words.append((own[codes[0]], numbers[0].astype(np.int64)))
        empty = pa.table({"row": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})
        if not parts and not given:
            return empty
        none = [np.array([], np.uint64)] * 3 + [np.array([], np.int64)]
        middle, before, last, lang = (np.concatenate(x) for x in zip(none, *parts, strict=True))
        del parts
        cuts = np.array([[model[x][level] for level in range(3)] for x in ids])          # language, size - 1, count
        total1, p0 = (np.array([model[x][k] for x in ids]) for k in (3, 4))

        # Trigrams and their contexts.
        codes, three, first = _grouped(_pair(_pair(before, middle), last))
        n3 = np.bincount(codes, minlength=len(three))
        middle, before, last, lang = middle[first], before[first], last[first], lang[first]
        cut3 = _cut(cuts[:, 2], lang, n3)
        context, contexts, _ = _grouped(_pair(before, middle))
        n_context = np.bincount(context, n3, len(contexts))
        gamma3 = np.maximum(np.bincount(context, cut3, len(contexts)) / n_context, 1e-6)

        # Pairs: of a hot word as given, else as counted here.
        cold = np.flatnonzero(~_among(hot, middle))
        codes, _, first = _grouped(_pair(middle[cold], last[cold]))
        first = cold[first]
        pairs = [[middle[first], last[first], lang[first], np.bincount(codes, minlength=len(first)), np.bincount(codes, n3[cold], len(first)).astype(np.int64)], *given]
        head, tail, of, c2, raw2 = (np.concatenate(x) for x in zip(*pairs, strict=True))
        two = _pair(head, tail)
        in_word, heads, first = _grouped(head)
        cut2, total2 = _cut(cuts[:, 1], of, c2), np.bincount(in_word, c2)
        gamma2 = np.maximum(np.bincount(in_word, cut2) / total2, 1e-6)
        follow = np.bincount(in_word, raw2)

        # Words. START is a context only.
        word, c1 = (np.concatenate(x) for x in zip(*words, (hot, hot_c1), strict=True))
        _, word, at = _grouped(word)
        number = pd.Index(word)
        c1 = c1[at]

        def p1(wanted: np.ndarray, lang: np.ndarray) -> np.ndarray:
            at = number.get_indexer(wanted)
            c = np.where(at >= 0, c1[at], 0)
            return np.where(c > 0, (c - _cut(cuts[:, 0], lang, c)) / total1[lang], 0) + p0[lang]
        share = p1(tail, of)
        p2 = (c2 - cut2) / total2[in_word] + gamma2[in_word] * share
        value2 = np.log(p2 / (gamma2[in_word] * share))
        value1 = np.log(p1(heads, of[first]) / p0[of[first]]) + np.log(gamma2)
        place2 = pd.Index(two)
        below = gamma3[context] * p2[place2.get_indexer(_pair(middle, last))]
        value3 = np.log(((n3 - cut3) / n_context[context] + below) / below)
        log3 = np.log(gamma3)
        del middle, before, last, lang, codes, cut3, context, below, pairs, head, tail, p2, share, cold

        def standing(at: np.ndarray, n: np.ndarray, raw: np.ndarray, value: np.ndarray) -> np.ndarray:
            """A trusted text is scored without the grams that only it has: else each would look better than any text that wasn't counted."""
            found = np.where(at >= 0, value[at], 0)
            own = np.flatnonzero(n)
            found[own[raw[at[own]] <= n[own]]] = 0
            return found
        place1, place_context, place3 = pd.Index(heads), pd.Index(contexts), pd.Index(three)
        out_rows, out_totals = [], []
        for kind, blob, row in zip(kinds, _blobs(table), table["row"], strict=True):
            if kind != _TRIGRAMS:
                continue
            own, (middle, before, last), (_, text, *times) = _unpacked(blob, 3)
            # Only a word that trusted text has can begin a known pair, and only known pairs can make a known trigram.
            at = place1.get_indexer(own)[middle]
            known = np.flatnonzero(at >= 0)
            at, text, one, two, pair, trigram = (x[known] for x in (at, text, *times))
            middle, before, last = (own[x[known]] for x in (middle, before, last))
            start = _pair(before, middle)
            value = standing(at, one, follow, value1)
            at_start, at_pair = place_context.get_indexer(start), place2.get_indexer(_pair(middle, last))
            value += standing(at_pair, pair, raw2, value2)
            if len(three):
                value += standing(at_start, two, n_context, log3)
                both = np.flatnonzero((at_start >= 0) & (at_pair >= 0))
                value[both] += standing(place3.get_indexer(_pair(start[both], last[both])), trigram[both], n3, value3)
            row = row.values.to_numpy()
            total = np.bincount(text, value, len(row) + 1)[:len(row)].astype(float)
            some = np.flatnonzero(total)
            out_rows.append(row[some])
            out_totals.append(total[some])
        return pa.table({"row": np.concatenate(out_rows), "total": np.concatenate(out_totals)}) if out_rows else empty

    def run(table: pa.Table) -> pa.Table:
        try:
            return score(table)
        finally:
            give_back()
    return sent.groupBy("shard").applyInArrow(run, "row long, total double")


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it has ended, not when the driver happens to collect its garbage, and rows go to Python in small batches."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def scored(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """row, tokens and total (sum of values of its grams) of docs (row, model, text, trusted); and (model, unknown, last, texts): the log probability of an
    unseen token, the value of a text's end, and the number of trusted texts. If a text's model is POOLED, all trusted text is counted there as well.
    """
    spark = docs.sparkSession
    with _settings(spark):
        return _all_scored(spark, docs)


def _all_scored(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    def kept(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
        path = new_path(spark, name)
        df.write.partitionBy(*by).parquet(path)
        return spark.read.schema(df.schema).parquet(path), path
    measured, _ = kept(_measured(docs, HOT_SHARE), "text-sizes")
    every = measured.agg(F.sum("tokens")).first()[0] or 0
    often = measured.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") * 2 * HOT_SHARE > every)
    uses = measured.where("row is not null").select("model", "trusted").distinct().collect()
    langs = sorted({x.model for x in uses if x.trusted})
    pooled = bool(langs) and any(x.model == POOLED for x in uses)      # counted only if a text needs it
    langs = sorted({*langs, POOLED}) if pooled else langs
    ends = {x: _mix(np.array([END], np.uint64) + _seed(x))[0] for x in langs}
    frequent = np.array([x[0] for x in often.select("key").collect()], np.int64).view(np.uint64)
    hot = np.unique(np.concatenate([np.array([*ends.values()], np.uint64), *(_mix(frequent + _seed(x)) for x in langs)]))
    shards = PASSES * max(LEAST_SHARDS, math.ceil(every / SHARD / PASSES))
    counted = _counted(_sent(docs, pooled, hot, max(2, shards // 2), None), hot, shards)
    counted, path = kept(counted.withColumn("turn", F.pmod("shard", F.lit(PASSES))), "gram-counts", "turn")
    counts: dict[str, list[dict[int, int]]] = {x: [{}, {}, {}] for x in langs}
    for r in counted.where("level > 0").groupBy("lang", "level", "c").agg(F.sum("n").alias("n")).collect():
        counts[r.lang][r.level - 1][r.c] = r.n
    hot_words = {np.int64(r.key).view(np.uint64): r for r in counted.where("level = 0").groupBy("lang", "key").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()}
    for r in hot_words.values():
        counts[r.lang][0][r.c] = counts[r.lang][0].get(r.c, 0) + 1
    model, ends_of = {}, []
    for lang, own in counts.items():
        if not own[0]:
            continue
        cuts = [_cuts(x) for x in own]
        total = sum(c * n for c, n in own[0].items())
        gamma = max(sum(min(cuts[0][min(c, 3)], c) * n for c, n in own[0].items()) / total, 1e-6)
        p0 = gamma / (sum(own[0].values()) + 1)
        model[lang] = (*cuts, total, p0)
        end = hot_words[ends[lang]]
        ends_of.append((lang, math.log(p0), math.log(((end.c - min(cuts[0][min(end.c, 3)], end.c)) / total + p0) / p0), end.n))
    hot_c1 = np.array([hot_words[x].c if x in hot_words else 0 for x in hot], np.int64)
    sums = []
    for turn in range(PASSES if model else 0):
        sent = _sent(docs, pooled, hot, shards, turn).unionByName(counted.where(f"turn = {turn}").drop("turn"))
        sums.append(kept(_scored(sent, model, hot, hot_c1).groupBy("row").agg(F.sum("total").alias("total")), "text-sums")[0])
        removed(spark, f"{path}/turn={turn}")            # no later turn needs it
    removed(spark, path)
    # Repeated rows are equal: each brings the same sum.
    found = measured.where("row is not null").groupBy("row").agg(F.max("tokens").alias("tokens"), F.count(F.lit(1)).alias("times"))
    empty = spark.createDataFrame([], "row long, total double")
    found = found.join(reduce(DataFrame.unionByName, sums, empty).groupBy("row").agg(F.sum("total").alias("total")), "row", "left")
    return found.select("row", "tokens", F.coalesce(F.col("total") / F.col("times"), F.lit(0.0)).alias("total")), spark.createDataFrame(
        ends_of, "model string, unknown double, last double, texts long")
