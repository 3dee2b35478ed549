"""Ids of whole texts by a public tokenizer, tokenized word by word.

The vocabulary drops white space and no token crosses it, so a text's ids are those of its words in turn. Words repeat:
a task tokenizes a word once and looks it up from then on, in a table of bounded size. Words that repeat stay for the worker's next task, up to a bound.
"""

from __future__ import annotations

import os
import unicodedata
from collections import defaultdict
from itertools import count, islice
from string import ascii_lowercase, ascii_uppercase, punctuation

import numpy as np
import pyarrow as pa

TOKENIZER = "word_bpe_49k.json"
BATCH = 8192                 # words that are tokenized at once
SLICE = 1 << 20              # bytes of texts that are encoded at once: a slice needs some forty times as much for a moment


class WordIds:
    """The ids of the words met so far. Beyond `most` words those met only once are forgotten."""

    def __init__(self, tokenizer: str, most: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer if os.path.sep in tokenizer else public_tokenizers.path(tokenizer))
        self.most = most
        self._learn_rules()
        self.clear()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn_rules(self) -> None:
        """What the tokenizer does with spaces, capitals and closing marks: which words need not be tokenized on their own."""
        if self._ids("word\nanother  word") != self._ids("word") + self._ids("another") + self._ids("word"):
            raise ValueError("the tokenizer doesn't go word by word")
        # Every capital between letters, and at either end of a word.
        self.folds = all(self._ids(f"{a}b{a}{a}x{a}") == self._ids(f"{b}b{b}{b}x{b}") for a, b in zip(ascii_uppercase, ascii_lowercase, strict=True))
        # A run of such signs behind a letter. Apostrophes may belong to letters that follow.
        self.marks = "".join(m for m in punctuation if m != "'" and all(self._ids(f"a{x}{m}") == self._ids(f"a{x}") + self._ids(m) for x in ascii_lowercase))
        self.tails: dict[str, bool] = {}
        # Words of letters may come to the model whole, each letter as some signs: they go there directly.
        self.letters = _Letters(self.tokenizer) if _Letters.may_serve(self.tokenizer) else None
        pairs = [f"{a}{b}" for a in ascii_lowercase for b in ascii_lowercase]
        if self.letters is not None:
            met = [w.translate(self.letters) for w in pairs]
            if any(_APART in p or [t.id for t in self.tokenizer.model.tokenize(p)] != e.ids
                   for p, e in zip(met, self.tokenizer.encode_batch_fast(pairs, add_special_tokens=False), strict=True)):
                self.letters = None

    def _core(self, word: str) -> str:
        """The word without closing marks, if the tokenizer sets those apart: behind a letter that stays one when it is normalized."""
        core = word.rstrip(self.marks)
        if len(core) == len(word) or not core.isalpha() or not self._apart(word[len(core):]):
            return word
        return core if core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha() else word

    def _apart(self, tail: str) -> bool:
        if len(tail) < 2:
            return True
        if tail not in self.tails:
            if len(self.tails) >= BATCH:
                self.tails.clear()
            self.tails[tail] = self._ids(f"a{tail}") == self._ids("a") + self._ids(tail)
        return self.tails[tail]

    def rest(self, most: int = 200_000, often: int = 2) -> None:
        """Between two tasks no more words stay than this, and of more only those that were met often."""
        if len(self.words) > most:
            self._forget(often)
            if len(self.words) > most:
                self.clear()
        self.seen[:len(self.words)] = 0

    def clear(self) -> None:
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.seen = np.zeros(1 << 16, np.int32)
        self.words, self.used = _numbered([]), 0

    def _forget(self, often: int = 2) -> None:
        """Keeps the words that were met so often."""
        kept = np.flatnonzero(self.seen[:len(self.words)] >= often)
        words = list(self.words)
        starts, lengths, ids = self.starts[kept], self.lengths[kept], self.ids
        self.clear()
        if 2 * len(kept) > self.most:
            return
        self.words = _numbered([words[k] for k in kept])
        upto = np.concatenate([[0], np.cumsum(lengths)])
        self.ids = _room(self.ids, int(upto[-1]))
        self.ids[:upto[-1]] = ids[np.repeat(starts - upto[:-1], lengths) + np.arange(upto[-1])]
        self.starts, self.lengths = _room(self.starts, len(kept)), _room(self.lengths, len(kept))
        self.starts[:len(kept)], self.lengths[:len(kept)] = upto[:-1], lengths
        self.used = int(upto[-1])

    def _learn(self, first: int) -> None:
        """Tokenizes the words from that number on."""
        added = len(self.words) - first
        if not added:
            return
        new = list(islice(reversed(self.words), added))[::-1]
        # A word with closing marks is the word's ids and the marks'; capitals A-Z may not matter.
        core = self._core
        cores = [w if w.isalpha() else core(w) for w in new]
        plain = [c.lower() if self.folds and not c.islower() and c.isascii() and c.isalpha() else c for c in cores]
        number, fresh = self.words.get, {}
        # Where each word's ids are: those of an older word, or behind all those, of a fresh one.
        at = [n if c is not w and (n := number(c, first)) < first else first + fresh.setdefault(c, len(fresh)) for c, w in zip(plain, new, strict=True)]
        closed = [k for k, (c, w) in enumerate(zip(cores, new, strict=True)) if len(c) < len(w)]
        tails = [n if (n := number(c, first)) < first else first + fresh.setdefault(c, len(fresh)) for c in (new[k][len(cores[k]):] for k in closed)]
        flat, sizes = self._tokenized(list(fresh))
        self.ids = _room(self.ids, self.used + len(flat))
        self.ids[self.used:self.used + len(flat)] = flat
        all_starts = np.concatenate([self.starts[:first], self.used + np.cumsum(sizes) - sizes])
        all_lengths = np.concatenate([self.lengths[:first], sizes])
        self.used += len(flat)
        starts, lengths = all_starts[at], all_lengths[at]
        if closed:                                       # ids of their own: the core's and the marks'
            both = np.stack([np.array(at)[closed], tails], axis=1).ravel()
            parts = all_lengths[both]
            upto = np.concatenate([[0], np.cumsum(parts)])
            joined = self.ids[np.repeat(all_starts[both] - upto[:-1], parts) + np.arange(upto[-1])]
            self.ids = _room(self.ids, self.used + len(joined))
            self.ids[self.used:self.used + len(joined)] = joined
            starts[closed], lengths[closed] = self.used + upto[:-1:2], parts[::2] + parts[1::2]
            self.used += len(joined)
        self.starts, self.lengths = _room(self.starts, first + added), _room(self.lengths, first + added)
        self.starts[first:first + added], self.lengths[first:first + added] = starts, lengths

    def _tokenized(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many each has."""
        letters, tokenize = self.letters, self.tokenizer.model.tokenize
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for k in range(0, len(words), BATCH):            # what the tokenizer returns is much larger than the ids
            part, ids, ends = words[k:k + BATCH], [], [0]
            pieces = [w.translate(letters) if letters is not None and (w.isascii() or unicodedata.is_normalized("NFC", w)) else _APART for w in part]
            pieces = [None if _APART in piece else piece for piece in pieces]
            encoded = iter(self.tokenizer.encode_batch_fast([w for w, piece in zip(part, pieces, strict=True) if not piece], add_special_tokens=False))
            for piece in pieces:
                ids += [t.id for t in tokenize(piece)] if piece else next(encoded).ids
                ends.append(len(ids))
            flat.append(np.array(ids, np.uint32))
            sizes.append(np.diff(ends))
        return np.concatenate(flat), np.concatenate(sizes)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn (null: none), each followed by `end`, and the bounds of each text in them."""
        if len(self.words) > self.most:
            self._forget()
        first, number, counts, numbers = len(self.words), self.words.__getitem__, [], []
        for text in texts.to_pylist():
            words = text.replace("\n", " ").split(" ") if text else []
            counts.append(len(words))
            numbers.append(np.fromiter(map(number, words), np.int64, len(words)))
        self._learn(first)
        at = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        self.seen = _room(self.seen, len(self.words))
        met = np.bincount(at, minlength=len(self.seen)).astype(np.int32)
        np.add(self.seen, met, out=self.seen)
        lengths = self.lengths[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        flat = self.ids[np.repeat(self.starts[at] - upto[:-1], lengths) + np.arange(upto[-1])]
        text_ends = upto[np.cumsum(counts)] if counts else np.zeros(0, np.int64)
        out = np.insert(flat, text_ends, np.uint32(end))
        return out, np.concatenate([[0], text_ends + np.arange(1, len(counts) + 1)]).astype(np.int64)


_APART = "\0"                # stands for a sign that doesn't go to the model directly


class _Letters(dict):
    """What the model is given for a letter, asked of the tokenizer's own steps when the letter is first met: the same wherever it stands in a word, or _APART."""

    def __init__(self, tokenizer) -> None:
        self._normalizer, self._splitter = tokenizer.normalizer, tokenizer.pre_tokenizer

    @staticmethod
    def may_serve(tokenizer) -> bool:
        """Whether a word of letters meets nothing but these steps and the model."""
        plain = tokenizer.truncation is None and tokenizer.padding is None and tokenizer.pre_tokenizer is not None
        return plain and not any(t.content.strip().isalpha() for t in tokenizer.get_added_tokens_decoder().values())

    def _pieces(self, word: str) -> list[str]:
        normal = word if self._normalizer is None else self._normalizer.normalize_str(word)
        return [piece for piece, _ in self._splitter.pre_tokenize_str(normal)]

    def __missing__(self, code: int) -> str:
        sign = chr(code)
        found = _APART
        if sign.isalpha():
            alone = self._pieces(sign)
            whole = [f"a{x}a" for x in alone], [f"a{x}" for x in alone], [f"{x}a" for x in alone], [f"{x}{x}" for x in alone]
            met = self._pieces(f"a{sign}a"), self._pieces(f"a{sign}"), self._pieces(f"{sign}a"), self._pieces(f"{sign}{sign}")
            if len(alone) == 1 and met == whole:
                found = alone[0]
        self[code] = found
        return found


def _numbered(words: list[str]) -> defaultdict[str, int]:
    """Numbers these words, and others in the order in which they are asked for."""
    return defaultdict(count(len(words)).__next__, zip(words, range(len(words))))


def _room(array: np.ndarray, least: int) -> np.ndarray:
    if least <= len(array):
        return array
    grown = np.zeros(max(least, 2 * len(array)), array.dtype)
    grown[:len(array)] = array
    return grown


_kept: dict[str, WordIds] = {}


def word_ids(tokenizer: str = TOKENIZER) -> WordIds:
    """This worker's table for the tokenizer: a file's path, or a name that `public_tokenizers` knows."""
    if tokenizer not in _kept:
        _kept[tokenizer] = WordIds(tokenizer)
    return _kept[tokenizer]
