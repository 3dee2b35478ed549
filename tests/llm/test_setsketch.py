"""SetSketch registers, their likelihood, and the near copies they find, against plain loops."""

import numpy as np
import pytest

from matchlens.llm import setsketch
from tests.llm.test_joins import brute_components


def some_set(random, n):
    return np.unique(random.integers(0, 2 ** 63, n).astype(np.uint64))


def pair(random, n, similarity):
    """Two sets of about n elements of about the given similarity."""
    common = int(round(2 * n * similarity / (1 + similarity)))
    every = random.integers(0, 2 ** 63, 2 * n).astype(np.uint64)
    return np.unique(every[:n]), np.unique(np.concatenate([every[:common], every[n:2 * n - common]]))


@pytest.mark.parametrize("n", [1, 2, 7, 300, 5000])
def test_registers_of_a_union_are_the_larger_ones(n):
    random = np.random.default_rng(n)
    a, b = some_set(random, n), some_set(random, 2 * n)
    both = np.union1d(a, b)
    assert (setsketch.registers(both) == setsketch.merged(setsketch.registers(a), setsketch.registers(b))).all()
    assert (setsketch.registers(a) == setsketch.registers(a[::-1])).all() and setsketch.registers(a).min() > 0


def test_no_elements_no_registers():
    assert (setsketch.registers(np.zeros(0, np.uint64)) == 0).all()


def test_registers_follow_the_size():
    """A register's value is 1 + log_B(20 n) but for the spread of a minimum: its mean gives the size."""
    random = np.random.default_rng(2)
    for n in (1, 30, 4000):
        made = np.concatenate([setsketch.registers(some_set(random, n)) for _ in range(20)]).astype(float)
        earliest = setsketch.BASE ** (1 - made)
        assert 1 / (earliest.mean() * setsketch.RATE) == pytest.approx(n, rel=0.1)


@pytest.mark.parametrize("similarity", [0.2, 0.5, 0.8, 0.95])
def test_equal_registers_are_as_frequent_as_common_elements(similarity):
    random = np.random.default_rng(3)
    equal = [(setsketch.registers(a) == setsketch.registers(b)).mean() for a, b in (pair(random, 400, similarity) for _ in range(60))]
    assert np.mean(equal) == pytest.approx(similarity, abs=0.03)


def test_likelihood_peaks_at_the_similarity():
    random = np.random.default_rng(4)
    found = {}
    for similarity in (0.3, 0.6, 0.8):
        best = []
        for _ in range(40):
            a, b = pair(random, 300, similarity)
            k_a, k_b = setsketch.registers(a), setsketch.registers(b)
            grid = np.linspace(0.01, min(len(a), len(b)) / max(len(a), len(b)) - 1e-6, 300)
            sides = (np.full(300, (k_a > k_b).sum()), np.full(300, (k_a < k_b).sum()))
            best.append(grid[setsketch.log_likelihood(grid, np.full(300, len(a)), np.full(300, len(b)), *sides).argmax()])
        found[similarity] = np.mean(best)
    assert found == pytest.approx({s: s for s in found}, abs=0.02)


def test_pairs_that_are_similar_are_never_ruled_out():
    random = np.random.default_rng(5)
    near = [pair(random, int(n), 0.81) for n in random.integers(20, 400, 200)]
    far = [pair(random, 300, 0.3) for _ in range(50)]
    for pairs, expected in ((near, True), (far, False)):
        k = [np.stack([setsketch.registers(p[side]) for p in pairs]) for side in (0, 1)]
        n = [np.array([len(p[side]) for p in pairs]) for side in (0, 1)]
        assert (setsketch.can_reach(80, *n, *k) == expected).all()
    bands = [sum(bool((setsketch.bands(setsketch.registers(a)) == setsketch.bands(setsketch.registers(b))).any()) for a, b in near)]
    assert bands == [len(near)]


@pytest.mark.parametrize(("width", "percent"), [(2, 80), (3, 90)])
def test_components_equal_brute_force(documents, width, percent):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = setsketch.near_duplicates(documents, width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_components(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_members_of_other_components_meet_in_blocks(spark, monkeypatch):
    """A chain whose ends are far from the hub, in blocks of two."""
    words = [f"w{k}" for k in range(60)]
    chain = [(k, " ".join([f"x{j}" if j < 2 * k else w for j, w in enumerate(words)])) for k in range(25)]
    docs = spark.createDataFrame(chain, "doc_id long, text string")
    monkeypatch.setattr(setsketch, "BLOCK", 2)
    found = setsketch.near_duplicates(docs, 2, 80).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=repr) == brute_components(chain, 2, 80)


def test_no_documents(no_documents):
    assert setsketch.near_duplicates(no_documents).collect() == []
