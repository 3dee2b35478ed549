"""FM-index searches and spelling forms against plain loops."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from matchlens.llm import variants


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_forms(rows):
    n = brute_words(rows)
    near = {w: [x for x in n if one_error(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=repr)


def invented(random, letters, n, least=7, most=12):
    """Words of few letters, with variants of one and two errors."""
    out = set()
    while len(out) < n:
        word = "".join(random.choice(letters, random.integers(least, most)))
        out.add(word)
        for _ in range(3):
            at, kind, letter = random.integers(len(word)), random.integers(3), random.choice(letters)
            word = word[:at] + (letter if kind else "") + word[at + (kind < 2):]
            if len(word) >= least:
                out.add(word)
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "zyxwvutsrqponmlkjihgfedcbaÿà"])
def test_searches_find_all_words_one_error_away(letters):
    words = invented(np.random.default_rng(len(letters)), list(letters), 300)
    expected = {(a, b) for a in words for b in words if one_error(a, b)}
    for index, queries in ((words, words), (words[:150], words[100:]), (words[::3], words)):
        found = set()
        for backwards in (False, True):
            who, whom = variants.near_words(index, queries, backwards)
            found |= {(queries[a], index[b]) for a, b in zip(who, whom, strict=True)}
        assert {(a, b) for a, b in found if a != b} == {(a, b) for a, b in expected if a in set(queries) and b in set(index)}


def test_each_search_covers_its_half():
    words = ["abcdefgh", "abcdefgx", "xbcdefgh"]
    for backwards, other in ((False, 1), (True, 2)):
        who, whom = variants.near_words(words, words[:1], backwards)
        assert {(int(a), int(b)) for a, b in zip(who, whom, strict=True) if b != 0} == {(0, other)}


def test_states_in_many_parts(monkeypatch):
    words = invented(np.random.default_rng(8), list("abc"), 200)
    whole = [sorted(zip(*variants.near_words(words, words, b), strict=True)) for b in (False, True)]
    monkeypatch.setattr(variants, "STATES", 7)
    assert whole == [sorted(zip(*variants.near_words(words, words, b), strict=True)) for b in (False, True)]


def test_long_and_few_words():
    long = ["a" * 3000, "a" * 2999, "a" * 1500 + "b" + "a" * 1499, "b" * 7]
    who, whom = (np.concatenate(x) for x in zip(*(variants.near_words(long, long, b) for b in (False, True)), strict=True))
    assert {(int(a), int(b)) for a, b in zip(who, whom, strict=True) if a != b} == {(0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)}
    for words, queries in (([], ["abcdefg"]), (["abcdefg"], []), (["abcdefg"], ["abcdefg"])):
        assert not {(a, b) for a, b in zip(*variants.near_words(words, queries), strict=True) if words[b] != queries[a]}


@pytest.fixture(scope="module")
def rows():
    random = np.random.default_rng(9)
    words = invented(random, list("abcdé"), 150) + ["Maße", "ÀÉÎÕÜÿ÷×àb", "İstanbulları", "a" * 200]
    often = random.zipf(1.3, len(words)) % 400 + 1
    bag = [w.capitalize() if random.random() < 0.2 else w for w, k in zip(words, often, strict=True) for _ in range(int(k))]
    random.shuffle(bag)
    texts = [" ,\n-1"[random.integers(5)].join(bag[k:k + 50]) for k in range(0, len(bag), 50)]
    return [(k, t) for k, t in enumerate(texts)] + [(900, None), (901, ""), (902, " 12 !"), (0, texts[0]), (0, texts[0])]


def forms(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, word string").repartition(3)
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in variants.spelling_forms(docs).collect()), key=repr)


def test_forms_equal_brute_force(spark, rows):
    expected = brute_forms(rows)
    assert forms(spark, rows) == expected
    assert any(r[1] for r in expected) and any(r[2] != r[1] for r in expected if r[1])


def test_beginnings_with_many_words_are_cut_into_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(variants, "SHARD", 6)
    monkeypatch.setattr(variants, "HELD", 20)
    assert forms(spark, rows) == brute_forms(rows)


def test_no_words_no_rows(spark):
    assert forms(spark, []) == [] and forms(spark, [(1, None), (2, "abc abc")]) == []
    null_id = forms(spark, [(None, "abcdefgh abcdefgh")])
    assert len(null_id) == 1 and null_id[0][2:5] == (null_id[0][0], 2, 0)
