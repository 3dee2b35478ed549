"""Token files, packing, mixing, media, archives and nearest neighbours."""

import base64
import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from matchlens.llm import media, mixing, packing, permutation, token_output, warc
from matchlens.llm.common import small_batches
from matchlens.llm.tokens import WordIds, word_ids

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text, end):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_word_by_word_equals_whole_texts():
    texts = ["It's a test, isn't it. 12,5", "a b\x1cc\x85d", "<|endoftext|> x<|startoftext|>y", "ÉÀ é Σας ΣΑΣ İ", "\n\n \t x", "", None, "...,, a.,", "日本語 text."]
    for table in (word_ids(), WordIds("word_bpe_49k.json", most=3)):
        for _ in range(2):
            ids, bounds = table.encode(pa.array(texts), 7)
            for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
                assert ids[a:b].tolist() == ids_of(text, 7).tolist()


@pytest.mark.parametrize("mark", [",", "."])
def test_every_letter_before_a_closing_mark(mark):
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LM"]
    texts = [f"a{c}{mark} {c}{mark}" for c in points]
    ids, bounds = WordIds("word_bpe_49k.json").encode(pa.array(texts), 7)
    expected = TOKENIZER.encode_batch(texts, add_special_tokens=False)
    assert all(ids[a:b - 1].tolist() == e.ids for a, b, e in zip(bounds, bounds[1:], expected, strict=False))


def test_rules_are_those_of_the_tokenizer():
    with pytest.raises(ValueError):
        WordIds("byte_bpe_50k.json")
    table = WordIds("word_bpe_49k.json")
    texts = pa.array(["Often often OFTEN, " * 20 + "once", "पहाड़, İ."])
    for _ in range(3):
        ids, bounds = table.encode(texts, 7)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [ids_of(t.as_py(), 7).tolist() for t in texts]
        table.rest(most=2)
        assert len(table.words) <= 4


def test_words_of_letters_go_straight_to_the_model():
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] in "LMN"]
    texts = [f"{c} x{c}y X{c} {c}{c}z e\u0301{c} \u1100\u1161{c}" for c in points] + ["ΟΔΟΣ ΣΑΣ ΟΔΟΣ. don't DON'T,", "été ÉTÉ, naïve. Ångström", "", None]
    table = WordIds("word_bpe_49k.json")
    expected = TOKENIZER.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for _ in range(2):
        ids, bounds = table.encode(pa.array(texts), 7)
        assert all(ids[a:b - 1].tolist() == e.ids for a, b, e in zip(bounds, bounds[1:], expected, strict=False))
    table.clear()
    met = []

    class Watched:
        model = table.tokenizer.model

        def encode_batch_fast(self, words, **options):
            met.extend(words)
            return TOKENIZER.encode_batch_fast(words, **options)
    table.tokenizer = Watched()
    ids, _ = table.encode(pa.array(["Une phrase écrite, 12 mots. Été"]), 7)
    assert ids.tolist() == ids_of("Une phrase écrite, 12 mots. Été", 7).tolist() and set(met) == {"12", ",", "."}


@pytest.mark.parametrize("ids", [
    [], [0], [1], [49407], [2 ** 32 - 1] * 3, [2 ** 59, 1, 2 ** 60, 2 ** 63, 0], list(range(3000)), [1] * 5000, [0] * 59 + [2 ** 40] + [3] * 70])
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    words, offsets, apart = token_output.pack(ids)
    back = token_output.unpack(words, offsets, len(ids))
    back[apart] = ids[apart]
    assert back.tolist() == ids.tolist()
    assert sorted(apart.tolist()) == [k for k, v in enumerate(ids.tolist()) if v >= 2 ** 60]
    if len(ids) == 5000:
        assert len(words) < 100


def test_simple8b_random_round_trip():
    random = np.random.default_rng(1)
    for n in (1, 1023, 1024, 1025, 20000):
        ids = (random.integers(0, 2 ** 62, n) >> random.integers(0, 62, n)).astype(np.uint64)
        words, offsets, apart = token_output.pack(ids)
        back = token_output.unpack(words, offsets, n)
        back[apart] = ids[apart]
        assert (back == ids).all()


def test_token_files(spark, documents, no_documents):
    found = sorted((tuple(r) for r in token_output.simple8b(spark, documents).collect()), key=lambda r: r[1])
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in documents.collect()))
    at = 0
    for (known, doc_id, _, text), got in zip(rows, found, strict=True):
        ids = ids_of(text, 1)
        assert got == (doc_id if known else None, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_output.simple8b(spark, no_documents).collect() == []


def test_packing_covers_every_id(documents, no_documents):
    for capacity in (64, 4096):
        found = packing.pack_documents(documents, capacity).toPandas()
        texts = documents.select("doc_id", "text").toPandas()
        assert (found["length"] > 0).all() and (found["length"] <= capacity).all()
        once = texts.groupby("doc_id")["text"].count()
        for r in found.itertuples():
            if r.doc_id == r.doc_id and once.get(r.doc_id, 0) <= 1:
                text = texts.loc[texts["doc_id"] == r.doc_id, "text"].iloc[0]
                ids = ids_of(text, 2)
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[int(r.start):int(r.start + r.length)].tobytes())
        for _, own in found.sort_values("start").groupby("doc_id"):
            assert own["length"].sum() % own["doc_tokens"].iloc[0] == 0
        for _, own in found.sort_values("offset").groupby("sequence_id"):
            ends = np.cumsum(own["length"])
            assert own["offset"].tolist() == [0, *ends[:-1]]
            assert ends.iloc[-1] <= capacity and ends.iloc[-1] & (ends.iloc[-1] - 1) == 0
        assert found["length"].sum() == sum(len(ids_of(t, 2)) for t in texts["text"])
    assert packing.pack_documents(no_documents).collect() == []


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_send_texts_in_small_batches(spark, stage):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 1000).alias("text"),
                                                  F.lit("en").alias("lang"), F.lit("a").alias("source"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["size"])
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), "")
        found = [r.size for r in docs.mapInArrow(sizes, "size long").collect()]
        assert sum(found) > 30_000_000 and max(found) < 6_000_000
        spark.conf.set(name, 1 << 20)                    # a bound that somebody has chosen stays
        small_batches(spark)
        assert spark.conf.get(name) == str(1 << 20)
    finally:
        spark.conf.unset(name)


def test_costs_are_balanced():
    random = np.random.default_rng(2)
    lengths = random.integers(1, 900, 4000).tolist()
    pieces, sequences = packing.assign(lengths, 4096, 1.0, 1 / 4096)
    cost = np.zeros(sequences)
    fill = np.zeros(sequences, int)
    for _, _, length, sequence, _ in pieces:
        cost[sequence] += length + length * length / 4096
        fill[sequence] += length
    full = cost[fill == 4096]
    assert fill.sum() == sum(lengths) and full.std() < 0.05 * full.mean()


# --- mixing -------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in stopped)
        free = sum(weight[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and left * weight[s] / free > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in stopped else left * weight[s] / free for s in names}
        stopped |= over


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 10, "c": 10, None: 5}, {"x": 0, "y": 7}, {"é": 50, "z": 60, "Z": 3, "": 1}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, size long, n long")
    found = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert found == pytest.approx(plain_targets(sizes))


def test_mix(documents, no_documents, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    found = mixing.mix(documents).toPandas()
    assert len(found) == documents.count()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in documents.collect()}
    assert all(words[d if d == d else None] == s for d, s in zip(found["doc_id"], found["size"], strict=True))
    assert (found["taken"] <= 3 * found["size"]).all() and (found["taken"] == found["size"] * found["copies"]).all()
    for _, own in found.groupby("source", dropna=False):
        assert own["source_size"].iloc[0] == own["size"].sum()
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max() * 2
    key = ["doc_id", "source", "size", "taken"]
    again = mixing.mix(documents.repartition(7)).toPandas()
    assert found[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    assert mixing.mix(no_documents).collect() == []


def test_sources_come_within_a_median_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = mixing.mix(docs).toPandas()
    for _, own in found.groupby("source", dropna=False):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].median()


def test_a_large_document_is_settled_by_small_ones():
    size = np.concatenate([[5000], np.full(400, 50)])
    taken = []
    for bucket in range(300):
        frame = pd.DataFrame({"doc_id": range(401), "source": "a", "size": size, "n": 1, "whole": 0, "part": 0.3, "bucket": bucket, "alone": True})
        out = mixing._round_group(frame, 0, 1)
        still = out[(out["part"] > 0) & (out["part"] < 1)]
        assert len(still) <= 1 and (still["size"] == 50).all()
        assert (out["part"] * out["size"]).sum() == pytest.approx(0.3 * size.sum())
        taken.append(out.loc[out["size"] == 5000, "part"].iloc[0])
    assert set(taken) == {0.0, 1.0} and np.mean(taken) == pytest.approx(0.3, abs=0.08)      # its expectation is kept


def test_mixed_rows(documents, no_documents):
    counts = {}
    for r in mixing.mix(documents).collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.copies
    got = mixing.mixed(documents)
    assert got.columns == documents.columns
    found = {}
    for r in got.collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + 1
    assert found == {k: v for k, v in counts.items() if v}
    assert mixing.mixed(no_documents).collect() == []


# --- media --------------------------------------------------------------------------------


def test_document_media(documents, no_documents):
    found = media.document_media(documents).collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(found) == documents.count()
    same = {}
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        payload = data + bytes((-len(data)) % 64 or (0 if data else 64))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        same.setdefault(texts[r.doc_id] or "", set()).add(r.feature)
    assert all(len(x) == 1 for x in same.values())
    assert media.document_media(no_documents).collect() == []


def test_positions_and_captions_stay_aligned(spark):
    page = ('<p>Before</p><script>x</script><figure><img src="a"><img src="b" alt="own"><figcaption>Both &amp; all</figcaption></figure>'
            '<p>Middle<img src="gone" alt="alt text">after</p>')
    assert media.sequence(page) == [
        (0, "text", "Before", None, None), (1, "media", None, "a", "Both & all"), (2, "media", None, "b", "Both & all"), (3, "text", "Middle", None, None),
        (4, "media", None, "gone", "alt text"), (5, "text", "after", None, None)]
    assert media.sequence(None) == media.sequence("") == []
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    payloads = spark.createDataFrame([("a", 5), ("b", 6)], "ref string, n_bytes long")
    got = media.resolve(media.sequences(pages, "page_id", "html"), payloads, "page_id")
    assert sorted(tuple(r) for r in got.select("page_id", "position", "ref", "caption", "n_bytes").collect()) == [
        (1, 1, "a", "Both & all", 5), (1, 2, "b", "Both & all", 6), (1, 4, "gone", "alt text", None)]


# --- archives -----------------------------------------------------------------------------


def test_archives(spark):
    pages = [(3, "http://x/\r\n3", "<p>same\r\n\r\nWARC/1.1\r\n</p>", 1), (1, "http://x/1", "<p>same\r\n\r\nWARC/1.1\r\n</p>", 1), (7, None, None, 1), (5, "u", "", 1),
             (9, "u", "é" * 5000, 1), (2, "u", "own", 1), (2, "u", "own", 1), (None, "u", "own", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, kind int")
    for least, revisits in ((0, {3: 1, 7: 5}), (10, {3: 1})):
        got = warc.page_rows(warc.transactions(df, least)).collect()
        assert len(got) == len(pages)
        html = {p[0]: (p[2] or "").encode() for p in pages}
        for r in got:
            data = html[r.page_id]
            assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            assert (r.record_type, r.refers_to) == (("revisit", revisits[r.page_id]) if r.page_id in revisits else ("response", None))
    assert warc.page_rows(warc.transactions(df.limit(0))).collect() == []
    one = warc.transactions(df.where("page_id = 9")).collect()
    assert len(one) == 1 and one[0].request.record_id and one[0].metadata.page_id == 9 and one[0].response.kind == "response"


# --- nearest neighbours -------------------------------------------------------------------


def test_recall_and_order(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    frame = vectors.toPandas()
    matrix, ids = np.stack(frame["vector"]).astype(float), frame["vec_id"].to_numpy()
    found = permutation.search(vectors, vectors.where("vec_id % 20 = 0"), 20).toPandas()
    hits = 0
    queries = ids[ids % 20 == 0]
    for q in queries:
        scores = matrix @ matrix[ids == q][0]
        scores[ids == q] = -np.inf
        best = set(ids[np.argsort(-scores)[:20]])
        own = found[found["query_id"] == q].sort_values("rank")
        assert len(own) == 20 and own["rank"].tolist() == list(range(1, 21)) and own["score"].is_monotonic_decreasing
        assert np.allclose(own["score"], [scores[ids == v][0] for v in own["vec_id"]])
        hits += len(best & set(own["vec_id"]))
    assert hits / (20 * len(queries)) >= 0.9


@pytest.mark.parametrize(("n", "spread"), [(20_000, 1.0), (200_000, 0.0), (200_000, 1.0)])
def test_recall_at_size_and_with_unequal_lengths(n, spread):
    """The blocks of a larger table, searched as the tasks do, against all inner products."""
    random = np.random.default_rng(n)
    matrix = random.standard_normal((n, 32)).astype(np.float32).astype(float)
    matrix *= random.lognormal(0, spread, n)[:, None] / np.linalg.norm(matrix, axis=1, keepdims=True)
    pivots = matrix[random.choice(n, permutation._pivots(n), replace=False)]
    pivots = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
    asked = matrix[random.choice(n, 20, replace=False)]
    near, blocks = permutation.near_pivots(asked, pivots), -(-n // permutation.BLOCK)
    most, found = -(-permutation._candidates(n) // blocks), [[] for _ in asked]
    for b in range(blocks):
        rows = np.arange(b, n, blocks)
        lists = permutation.inverted(permutation.near_pivots(matrix[rows], pivots), len(pivots))
        worth = permutation._expected(matrix[rows], asked, near, lists)
        for q, own in enumerate(near):
            found[q].append(rows[np.argpartition(-worth(own), most - 1)[:most]])
    hits = [np.isin(np.argsort(-(matrix @ q))[:20], np.concatenate(f)).sum() for q, f in zip(asked, found, strict=True)]
    assert sum(hits) / (20 * len(asked)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.5]) for k in range(60)] + [(100, [0.0, 0.0]), (101, None), (102, [1.0, None]), (103, [nan, 1.0]), (104, [inf, 1.0]), (105, [1.0]), (106, [2.0, 1.0]),
            (106, [2.0, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    found = permutation.search(df, df, 20).toPandas()
    assert set(found["query_id"]) == {*range(60), 106}
    own = found[found["query_id"] == 3].sort_values("rank")
    assert own["vec_id"].tolist() == [106, *[k for k in range(21) if k != 3][:19]]
    assert found[found["query_id"] == 106].sort_values("rank")["vec_id"].tolist() == list(range(20))
    few = df.where("vec_id in (1, 2)")
    assert len(permutation.search(few, few, 20).collect()) == 2
    assert permutation.search(df.limit(0), df.limit(0), 20).collect() == []
