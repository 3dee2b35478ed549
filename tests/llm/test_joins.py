"""PartEnum join and line templates against plain loops."""

import re
from itertools import combinations

import numpy as np
import pytest

from matchlens.llm import components as linked
from matchlens.llm import linededup, partenum, setsketch
from matchlens.llm.common import salted_join, written
from matchlens.llm.components import components
from matchlens.llm.shingles import shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)}


def brute_components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(k):
        while label[k] != k:
            k = label[k]
        return k
    for a, b in combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            label[find(b)] = find(a)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    smallest = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[k][0], len(sets[k]), smallest[find(k)]) for k in range(len(rows))), key=repr)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(documents, width, percent):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in partenum.jaccard_components(documents, width, percent).collect()), key=repr)
    assert found == brute_components(rows, width, percent)


def test_large_groups_are_compared_in_blocks(documents, monkeypatch):
    monkeypatch.setattr(partenum, "BLOCK", 2)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = sorted((tuple(r) for r in partenum.jaccard_components(documents, 3, 70).collect()), key=repr)
    assert found == brute_components(rows, 3, 70)


def test_no_documents_no_components(no_documents):
    assert partenum.jaccard_components(no_documents).collect() == []
    assert partenum.without_near_copies(no_documents).columns == no_documents.columns


def test_similar_sets_share_a_signature():
    random = np.random.default_rng(3)
    for percent in (80, 90):
        for size in (1, 2, 5, 9, 10, 17, 40, 300):
            for _ in range(20):
                a = np.unique(random.integers(0, 2 ** 63, size).astype(np.uint64))
                drop = int(size * (100 - percent) / 100)
                b = np.sort(random.permutation(a)[drop:])
                if len(b) * 100 >= percent * len(a):
                    assert np.intersect1d(partenum.signatures(a, percent), partenum.signatures(b, percent)).size
                swapped = drop // 2
                b = np.unique(np.concatenate([random.permutation(a)[swapped:], random.integers(0, 2 ** 63, swapped).astype(np.uint64)]))
                common = len(np.intersect1d(a, b))
                if common * 100 >= percent * (len(a) + len(b) - common):
                    assert np.intersect1d(partenum.signatures(a, percent), partenum.signatures(b, percent)).size


def test_shingle_counts():
    for text in ("a b c d a b c", "A b", "", None, " \n", "x" * 1000, "a b c d"):
        assert len(shingle_set(text, 3)) == len(shingles(text, 3))


def test_chains_become_one_component(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.label) for r in components(chain).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}
    assert components(chain.limit(0)).collect() == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_copies_of_a_table_are_not_broadcast(spark, how):
    """Spark estimates the table without its copies: one that just fits would be sixteen times too large for the driver."""
    rows = spark.range(60).selectExpr("if(id % 10 = 0, null, id % 7) k", "id v")
    small = written(spark.range(5).selectExpr("if(id = 4, null, id) k", "id * id w"), "small")
    found = salted_join(rows, small, ["k"], ["v"], how)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    squares = {k: k * k for k in range(4)}
    expected = [(None if v % 10 == 0 else v % 7, v) for v in range(60)]
    assert sorted((tuple(r) for r in found.select("k", "v", "w").collect()), key=repr) == sorted(
        ((k, v, squares.get(k)) for k, v in expected if k in squares or how == "left"), key=repr)


def copies_broadcast(plan):
    """Whether a broadcast of the plan's tree holds an exploded table, or the parities of a set again for each band or signature."""
    lines = plan.split("\n")
    for at, line in enumerate(lines):
        for below in lines[at + 1:] if "BroadcastExchange" in line else []:
            if re.search(r"\w", below).start() <= line.index("BroadcastExchange"):
                break
            if "Generate explode" in below or re.search(r"\bf0#", below) and re.search(r"\b(band|signature)#", below):
                return True
    return False


@pytest.mark.parametrize("operator", [partenum.jaccard_components, setsketch.near_duplicates])
def test_joins_of_near_copies_broadcast_no_copies(documents, monkeypatch, operator):
    plans = []

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString().rstrip()))
        return written(df, name)
    for module in (partenum, setsketch, linked):
        monkeypatch.setattr(module, "written", seen)
    plans.append(("result", operator(documents, 3, 70)._jdf.queryExecution().executedPlan().toString().rstrip()))
    assert sum("Generate explode" in plan for _, plan in plans) > 3 and [name for name, plan in plans if copies_broadcast(plan)] == []


def test_one_document_of_each_group_stays(documents):
    kept = partenum.without_near_copies(documents, 3, 90)
    assert kept.columns == documents.columns
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    expected = sorted(repr(d) for d, _, c in brute_components(rows, 3, 90) if d is None or c is None or d <= c)
    assert sorted(repr(r.doc_id) for r in kept.collect()) == expected


# --- lines --------------------------------------------------------------------------------


def brute_lines(rows):
    """Templates by plain loops: (doc_id, text) -> kept text."""
    def tokens(line):
        return tuple("<*>" if re.search("[0-9@]", t) else t for t in WORD.findall(line))
    distinct = {}
    for doc_id, text in rows:
        if text is not None:
            distinct.setdefault((doc_id, text), None)
    lines = []                                            # document, text, place, body, masked tokens
    for d, t in distinct:
        for at, line in enumerate(t.split("\n")):
            own = tokens(line)
            if own:
                lines.append((d, t, at, tuple(WORD.findall(line)) if 2 * own.count("<*>") > len(own) else own, own))
    bodies, leaves = {}, {}
    for _, t, _, body, own in lines:
        bodies.setdefault((body, own), set()).add(t)
    for key in bodies:
        leaves.setdefault((len(key[1]), key[1][:3]), []).append(key)
    template = {key: key[0] for key in bodies}
    for members in leaves.values():
        docs = [len(bodies[m]) for m in members]
        if len(members) > 1 and sum(docs) >= 3 and min(docs) < 3 and len(members[0][1]) >= 3:
            votes = {}
            for key in members:
                for at, token in enumerate(key[1]):
                    votes[at, token] = votes.get((at, token), 0) + len(bodies[key])
            for key in members:
                own = key[1]
                fixed = tuple((at, x) for at, x in enumerate(own) if votes[at, x] >= max(3, sum(docs) / 4) and x != "<*>")
                content = sum(at >= 3 for at, _ in fixed)
                if content and content >= (len(own) - 3) / 2:
                    template[key] = ("T", fixed)
    where, long = {}, {}
    for d, t, at, body, own in lines:
        place = (d is not None, d or 0, at, t)
        where.setdefault((len(own), own[:3], template[body, own]), []).append(place)
        if len(own) > 50:
            long.setdefault((own[:3], body), []).append(place)
    gone = set()
    for least, groups in ((None, where), (2, long)):
        for key, hits in groups.items():
            if len({t for *_, t in hits}) >= (least or (3 if key[0] >= 3 else 5)):
                gone |= {(d if known else None, t, at) for known, d, at, t in sorted(hits, key=lambda h: h[:3])[1:]}
    return sorted(repr((d, t if t is None else "\n".join(x for at, x in enumerate(t.split("\n")) if (d, t, at) not in gone))) for d, t in rows)


def test_lines_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = linededup.deduped(documents)
    assert found.columns == [*documents.columns, "n_lines", "n_dropped"]
    assert sorted(repr((r.doc_id, r.text)) for r in found.collect()) == brute_lines(rows)


def test_variable_fields_make_one_template(spark):
    texts = [f"This was posted by {n} on the old board\nbody of {n} alone" for n in ("ann", "bob", "cem", "dia")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.deduped(docs).collect()}
    assert found[0][1:] == (2, 0)
    assert all(found[k][2] >= 1 for k in (1, 2, 3))


def test_copies_alone_drop_nothing(spark):
    docs = spark.createDataFrame([(k, "one line of text\nand another one") for k in range(9)], "doc_id long, text string")
    assert {r.n_dropped for r in linededup.deduped(docs).collect()} == {0}


def test_no_documents_no_lines(no_documents):
    assert linededup.deduped(no_documents).collect() == []


def whole_lines(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.n_dropped for r in linededup.deduped(docs).collect()}


def test_lines_that_begin_alike_stay(spark):
    texts = ["Was erlytion that. A, reha.", "Was erlytion that. Ing eresnt.", "Was erlytion that. Oues ereaha.", "Was erlytion that. Heesat reorly thederble.",
             "Was erlytion that. Eaed heeaat en."]
    random = np.random.default_rng(1)                    # a large leaf, in which a frequent word stands at each place by chance
    texts += ["One two three " + " ".join(random.choice(["of", "the", *("w" + chr(97 + k) + x for k in range(20) for x in "abcdefgh")], 4,
                                                        p=[0.1, 0.1, *[0.8 / 160] * 160])) for _ in range(300)]
    texts += [f"{k} {k + 1} {k + 7} {k * k} 5" for k in range(9)]
    assert len(set(texts)) == len(texts) and set(whole_lines(spark, texts).values()) == {0}


def test_shared_content_is_a_template(spark):
    found = whole_lines(spark, [f"This was posted by {n} on the old board" for n in ("ann", "bob", "cem", "dia")] + ["Page 1 of the book", "Page 2 of the book", "Page 3 of the book"])
    assert [found[k] for k in range(7)] == [0, 1, 1, 1, 0, 1, 1]


def test_long_lines_recur_in_two_documents(spark):
    passage = " ".join("p" + chr(97 + k // 26) + chr(97 + k % 26) for k in range(51))
    shorter = passage.rsplit(" ", 1)[0]
    found = whole_lines(spark, [f"own start\n{passage}", f"{passage}\nanother end", f"x\n{shorter}", f"y\n{shorter}", f"first {passage}", f"second {passage}"])
    assert [found[k] for k in range(6)] == [0, 1, 0, 0, 0, 0]


def test_short_lines_recur(spark):
    texts = [f"Log in\nown {x} text\n{k}\nRead more\n\n12 {k}" for k, x in enumerate("abcdef")] + ["Rare\nown g text", "Rare\nown h text", "Rare\nown i text", "Rare\nown j text"]
    found = whole_lines(spark, texts)
    assert [found[k] for k in range(10)] == [0] + [2] * 5 + [0] * 4


def test_columns_of_any_name_come_through(clashing):
    """Rows keep all their columns; where the operator adds columns of that name, its own take their place."""
    from matchlens.llm import mixing
    before = {r.doc_id: r.asDict() for r in clashing.collect()}
    for out in (linededup.deduped(clashing, counts=False), partenum.without_near_copies(clashing, 3, 90), mixing.mixed(clashing)):
        assert out.columns == clashing.columns
        got = out.collect()
        assert got
        for r in got:
            assert {k: v for k, v in r.asDict().items() if k != "text"} == {k: v for k, v in before[r.doc_id].items() if k != "text"}
    counted = linededup.deduped(clashing)
    assert sorted(counted.columns) == sorted(clashing.columns) and {r.doc_id: r.n_lines for r in counted.collect()}[5] == before[5]["text"].count("\n") + 1
