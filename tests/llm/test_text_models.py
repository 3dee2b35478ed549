"""Language identification and perplexity."""

import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchlens.llm import langid, quality, wordmodel
from matchlens.llm.common import shared_folder

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert len(found) == docs.count() and len(held) > 100
    assert (held["lang"] == held["lang_pred"]).mean() > 0.98
    assert found["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(found["doc_id"], found["held_out"], strict=True))


def test_held_out_rows_are_not_learnt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs).collect()}
    assert a == {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(changed).collect()}


def test_undetermined_texts(documents, no_documents):
    found = {}
    for r in langid.predict(documents).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, found.values())) == documents.count()
    for row in documents.collect():
        letters = row.text is not None and any(c.isalpha() for c in row.text)
        for r in found[row.doc_id]:
            assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert langid.predict(no_documents).collect() == []
    assert langid.accepted(no_documents).columns == no_documents.columns
    assert langid.accepted(documents).columns == documents.columns


@pytest.mark.parametrize("languages", [1, 2, 4, 5, 9, 30])
def test_codewords_differ(languages):
    book = langid.codebook(languages)
    assert len({tuple(x) for x in book}) == languages
    if languages > 1:
        assert (np.abs(book.sum(axis=0)) < languages).all()


def test_trigrams_stay_in_their_text():
    hashed, starts, ends = langid.trigrams(pa.array(["ab", None, "", "Ab", "c"]))
    own = [hashed[a:b].tolist() for a, b in zip(starts, ends, strict=True)]
    assert own[0] == own[3] and list(map(len, own)) == [2, 0, 0, 2, 1]


# --- perplexity ---------------------------------------------------------------------------


def test_judged_documents(spark, documents, no_documents):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 40, 2)] + [(0, 1, 0), (1, 0, 0), (3, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    found = quality.judged(documents, labels).collect()
    assert len(found) == documents.count()
    by_id = {r.doc_id: r for r in found}
    for row in documents.collect():
        r = by_id[row.doc_id]
        assert (r.perplexity is None) == (not row.text) and r.n_symbols == len(row.text or "")
        assert r.keep == (r.perplexity is None or r.perplexity <= r.threshold)
    assert all(by_id[k].keep for k in range(0, 40, 4))
    nothing = quality.judged(documents, labels.limit(0)).collect()
    assert len(nothing) == documents.count() and all(r.keep and r.perplexity is None for r in nothing)
    assert quality.judged(no_documents, labels).collect() == []


def test_noise_is_less_likely(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = spark.createDataFrame([(10 ** 6, "xq zkw vvj qqx wzzk jxqv kqz", "en"), (10 ** 6 + 1, "?! %% @@ ## $$ && **", "en")], "doc_id long, text string, lang string")
    found = quality.judged(docs.select("doc_id", "text", "lang").union(noise), spark.read.parquet(f"{SF}/labels.parquet")).toPandas().set_index("doc_id")
    assert not found.loc[10 ** 6]["keep"] and not found.loc[10 ** 6 + 1]["keep"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    both = found.join(labels, how="inner")
    assert both[(both["quality"] == 1) & (both["toxic"] == 0)]["keep"].mean() > 0.98
    assert both[both["quality"] == 0]["keep"].mean() < 0.5


def test_word_order_and_vocabulary_count(spark):
    random = np.random.default_rng(2)
    words = ["".join(random.choice(list("aeioulmnrst"), 5)) for _ in range(60)]
    follow = {w: random.permutation(words)[:3] for w in words}

    def text(n):
        out = [words[int(random.integers(60))]]
        while len(out) < n:
            out.append(str(random.choice(follow[out[-1]])))
        return out
    clean = [text(80) for _ in range(200)]
    rows = [(k, " ".join(x), "en") for k, x in enumerate(clean)]
    for k, x in enumerate(clean[100:]):                  # the same words in another order, and other words of the same letters
        rows.append((1000 + k, " ".join(random.permutation(x)), "en"))
        rows.append((2000 + k, " ".join(w[::-1] for w in x), "en"))
    chinese = ["".join(chr(0x4e00 + int(c)) for c in random.integers(0, 40, 90)) for _ in range(60)]
    rows += [(3000 + k, x, "zh") for k, x in enumerate(chinese)] + [(4000, "".join(chr(0x5e00 + int(c)) for c in random.integers(0, 40, 90)), "zh")]
    labels = spark.createDataFrame([(k, 1, 0) for k in [*range(100), *range(3000, 3050)]], "doc_id long, quality int, toxic int")
    for hot in (1, 1 << 16):                             # grams by the join, and sent to every task
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(wordmodel, "HOT_SHARE", hot)
            found = {r.doc_id: (r.keep, r.perplexity) for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
        if hot > 1:
            assert all(found[k][1] == pytest.approx(last[k][1]) for k in found)
        last = found
    assert np.mean([found[k][0] for k in range(100, 200)]) > 0.9 and np.mean([found[k][0] for k in range(3050, 3060)]) > 0.9
    assert not any(found[k][0] for k in [*range(1000, 1100), *range(2000, 2100), 4000])


def brute_words(texts):
    """Interpolated modified Kneser-Ney over words by dictionaries."""
    counts = [{} for _ in range(4)]
    for text in texts:
        own = ["<", "<", *wordmodel.tokens(text), ">"]
        for k in range(2, len(own)):
            gram = tuple(own[k - 2:k + 1])
            counts[3][gram] = counts[3].get(gram, 0) + 1
    for size in (2, 1):
        for gram in counts[size + 1]:
            counts[size][gram[1:]] = counts[size].get(gram[1:], 0) + 1

    def cuts(size):
        n = [sum(v == k for v in counts[size].values()) for k in range(5)]
        if not n[1]:
            return [0, 0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) if n[k] else k / 2 for k in (1, 2, 3)]
    d = [None] + [cuts(size) for size in (1, 2, 3)]

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        own = {g: n for g, n in counts[len(gram)].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        cut = lambda n: d[len(gram)][min(n, 3)]
        gamma = max(sum(map(cut, own.values())) / sum(own.values()), 1e-6)
        n = own.get(gram, 0)
        return (n - cut(n)) / sum(own.values()) + gamma * p(gram[1:])
    return p


def test_word_model_equals_dictionaries(spark):
    trusted = ["a b c a b d", "b c d, a b c", "c a\nb c e", "d d a b c"]
    other = ["a b c d", "x a b y", "b b", "e", "\n", "b c d, a b c"]
    rows = [(k, t, "en") for k, t in enumerate(trusted + other)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(trusted))], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.perplexity for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    p = brute_words(trusted)
    for k, text in enumerate(other, len(trusted)):
        own = ["<", "<", *wordmodel.tokens(text), ">"]
        logs = [math.log(p(tuple(own[j - 2:j + 1]))) for j in range(2, len(own))]
        assert found[k] == pytest.approx(math.exp(-sum(logs) / len(logs)), rel=1e-6)


def test_names_follow_tokens():
    random = np.random.default_rng(4)
    letters = [*"aAbİΣς'-_ \t\n\r\u00a0\u0301\u3000\u4e00\u3042\u0e01\u0915\u094d\U00020000\U0001f600\0.,", "the "]
    texts = [None, "", " ", "\n", *("".join(random.choice(letters, int(n))) for n in random.integers(1, 60, 400)), "ab" * 100_000, "", "ab ba aab aba baa"]
    found, n = wordmodel.names(texts)
    words = [x for text in texts for x in wordmodel.tokens(text)]
    assert n.tolist() == [len(wordmodel.tokens(x)) for x in texts] and len(found) == len(words)
    assert len(set(found.tolist())) == len(set(words)) == len(set(zip(found.tolist(), words, strict=True)))


def wordy(spark):
    random = np.random.default_rng(8)
    words = ["w%d" % k for k in range(3000)] + ["the"] * 600
    rows = [(k, " ".join(random.choice(words, 150)), ["en", "fr", None][k % 3]) for k in range(400)] + [(5, "the same row", "en")] * 2
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels


def test_grams_do_not_stay_on_disk(spark):
    rows, docs, labels = wordy(spark)
    size = lambda: sum(os.path.getsize(f"{at}/{x}") for at, _, names in os.walk(shared_folder(spark).removeprefix("file:")) for x in names)
    before = size()
    assert len(quality.judged(docs, labels).collect()) == len(rows)
    assert size() - before < sum(len(x[1]) for x in rows)


@pytest.mark.parametrize(("share", "passes", "least"), [(1, 1, 1), (30, 2, 3), (1 << 16, 3, 5)])
def test_shards_do_not_matter(spark, monkeypatch, share, passes, least):
    _, docs, labels = wordy(spark)
    result = lambda: sorted(quality.judged(docs, labels).select("doc_id", "lang", "perplexity", "keep").collect(), key=repr)
    wanted = result()
    for name, value in (("HOT_SHARE", share), ("PASSES", passes), ("LEAST_SHARDS", least)):
        monkeypatch.setattr(wordmodel, name, value)
    for a, b in zip(result(), wanted, strict=True):
        assert (a.doc_id, a.lang, a.keep) == (b.doc_id, b.lang, b.keep) and a.perplexity == pytest.approx(b.perplexity)
