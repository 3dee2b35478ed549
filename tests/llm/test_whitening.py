"""Spectrum slicing and whitening against numpy's eigenvectors."""

import numpy as np
import pytest

from matchlens.llm import whitening

SCHEMA = "vec_id long, vector array<double>, n long, component string"


def brute(rows, k=8):
    good = [(i, np.array(v)) for i, v, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([np.floor(1024 * v) + 100000 for _, v in good]).astype(np.int64).astype(object)
    n, total = len(x), x.sum(axis=0)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    centred = ((n * x - total) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return {(i, c): (n, int(deviation[at]), float(centred[at] @ axes[:, c - 1]) / values[c - 1] ** 0.5, values[c - 1] / np.trace(centred.T @ centred / n))
            for at, (i, _) in enumerate(good) for c in range(1, k + 1)}


def check(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    expected = brute(rows)
    assert {(r.vec_id, r.component) for r in found} == set(expected)
    signs = {}
    for r in found:
        n, deviation, whitened, explained = expected[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation if deviation < 2 ** 63 else None) and r.explained == pytest.approx(explained, rel=1e-9)
        if abs(whitened) > 1e-3:
            signs.setdefault(r.component, np.sign(whitened * r.whitened))
        assert r.whitened == pytest.approx(signs.get(r.component, 1) * whitened, rel=1e-7, abs=1e-7)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in found}) == 1


def test_whitened_equals_numpy(spark):
    random = np.random.default_rng(1)
    data = random.standard_normal((300, 20)) * np.linspace(3, 0.2, 20) + random.standard_normal(20)
    rows = [(k, [float(x) for x in v], 5, "x") for k, v in enumerate(data)]
    check(spark, rows + [(1000, None, 1, ""), (1001, [None] + rows[0][1][1:], 1, ""), (1002, [float("nan")] * 20, 1, ""),
                         (1003, [float("inf")] * 20, 1, ""), (1004, [0.0] * 20, 1, "")])


def test_large_entries_stay_exact(spark):
    random = np.random.default_rng(2)
    check(spark, [(k, [float(x) for x in v], 0, "") for k, v in enumerate(random.standard_normal((40, 9)) * 2e4)])


def test_counts_are_those_of_the_eigenvalues():
    random = np.random.default_rng(3)
    for d in (1, 2, 3, 10, 40):
        a = random.standard_normal((d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*((values[1:] + values[:-1]) / 2), values[0] - 1, values[-1] + 1, 0.0]:
            assert whitening.below(a, shift) == (values < shift).sum()


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1], [1, 1, 1, 1, 1], [9, 9, 9, 2, 2, 0, 0], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 1e-6], [1e9, 1, 0.1, 0, 0]])
def test_leading_of_close_and_equal_eigenvalues(spectrum):
    random = np.random.default_rng(4)
    axes, _ = np.linalg.qr(random.standard_normal((len(spectrum), len(spectrum))))
    a = axes * np.array(spectrum, float) @ axes.T
    a = (a + a.T) / 2
    values, vectors = whitening.leading(a, len(spectrum))
    kept = [x for x in spectrum if x > 1e-12 * max(spectrum)]
    assert values == pytest.approx(kept, rel=1e-9, abs=1e-6 * 1e-9 * max(spectrum))
    assert np.abs(vectors.T @ vectors - np.eye(len(kept))).max() < 1e-12
    assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * max(spectrum)


def test_degenerate_tables(spark):
    def run(rows):
        return whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert run([]) == [] and run([(1, None, 0, ""), (2, [], 0, "")]) == []
    assert run([(1, [1.0, 2.0], 0, "")]) == [] and run([(1, [1.0, 2.0], 0, ""), (2, [1.0, 2.0], 0, "")]) == []      # no variance
    line = run([(None, [0.0, 0.0, 1.0], 0, ""), (2, [1.0, 1.0, 1.0], 0, ""), (2, [1.0, 1.0, 1.0], 0, ""), (3, [1.0], 0, "")])
    assert [r.component for r in line] == [1, 1, 1] and sorted(repr(r.vec_id) for r in line) == ["2", "2", "None"]
    assert all(r.n == 3 and r.explained == pytest.approx(1) for r in line)
