import math

import numpy as np
import pytest

from marketpulse.llm import whitening

SMALL = "/root/testdata/sf0.001/embeddings.parquet"
SCHEMA = "vec_id long, embedding array<double>, label int, n long, deviation string, whitened string, part int, state string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "d", "w", 3, "s") for i, v in rows], SCHEMA)


def whole(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return [i for i, _ in kept], [[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept]


def brute_force(rows):
    """By the eigenvectors of the covariance: rows of (id, n, deviation), whitened values up to sign, shares."""
    ids, x = whole(rows)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array(x, float) - np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:8]
    values, vectors, total = values[order], vectors[:, order], values.sum()
    return ids, n, deviations, centred @ vectors / np.sqrt(values), values / total


def compare(got, rows):
    ids, n, deviations, white, shares = brute_force(rows)
    by_component = {}
    for r in got:
        by_component.setdefault(r.component, []).append(r)
    assert sorted(by_component) == list(range(1, white.shape[1] + 1))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for k, found in by_component.items():
        assert len(found) == len(ids) and {r.n for r in found} == {n}
        assert all(abs(r.explained / shares[k - 1] - 1) < 1e-9 for r in found)
        sign = None
        expected = sorted(zip(ids, deviations, white[:, k - 1].tolist(), strict=True))
        for sign in (1, -1):
            mine = sorted((r.vec_id, r.deviation, sign * r.whitened) for r in found)
            if all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-7 for a, b in zip(mine, expected, strict=True)):
                break
        else:
            raise AssertionError(f"component {k} differs")


def test_equals_brute_force(spark):
    table = spark.read.parquet(SMALL)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    compare(whitening.report(table.repartition(40)).collect(), rows)


def test_rows_that_are_not_whole_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(5)
    rows = [(k, (rng.standard_normal(9) * np.arange(1, 10)).tolist()) for k in range(60)]
    rows += [(100, None), (101, [None] * 9), (102, [1.0, float("nan"), *[0.0] * 7]), (103, [float("inf")] * 9)]
    rows += [(104, [0.5, None, *[0.5] * 7]), (3, rows[3][1]), (3, rows[3][1]), (5, (-np.array(rows[5][1])).tolist())]
    got = whitening.report(frame(spark, rows).repartition(11)).collect()
    compare(got, rows)
    table = frame(spark, [*rows, (None, rows[0][1])])
    assert sum(r.vec_id is None for r in whitening.report(table).collect()) == 8


def test_few_dimensions_and_degenerate_tables(spark):
    rows = [(k, [float(k % 3), float(k % 5)]) for k in range(30)]
    compare(whitening.report(frame(spark, rows)).collect(), rows)
    same = [(k, [0.25, 0.5, 0.1]) for k in range(5)]
    columns = whitening.report(frame(spark, same)).columns
    for table in (same, [], [(1, None)], [(1, [1.0, 2.0])], [(1, []), (2, [])]):
        out = whitening.report(frame(spark, table))
        assert out.columns == columns and out.collect() == []


def test_lengths_and_sizes_that_are_refused(spark):
    with pytest.raises(Exception, match="different lengths"):
        whitening.report(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()
    with pytest.raises(Exception, match="too large"):
        whitening.report(frame(spark, [(1, [1e300]), (2, [1.0])])).collect()


def test_deviations_are_exact_or_null():
    x = np.array([[2**40, -(2**40)], [0, 0]])
    fitted = whitening.Whitening(2, [2**40, -(2**40)], np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    assert fitted.deviations(x).to_pylist() == [None, None]  # 2 * 2**80
    x = np.array([[3_000_000_007, 1], [3_000_000_001, 5]])
    fitted = whitening.Whitening(2, x.sum(axis=0).tolist(), np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    assert fitted.deviations(x).to_pylist() == [36 + 16, 36 + 16]


MATRICES = {
    "random": lambda rng: rng.standard_normal((500, 40)),
    "graded": lambda rng: rng.standard_normal((500, 40)) * np.logspace(0, -6, 40),
    "few rows": lambda rng: rng.standard_normal((5, 40)),
    "equal": lambda rng: np.linalg.qr(rng.standard_normal((300, 40)))[0],
    "clusters": lambda rng: np.linalg.qr(rng.standard_normal((300, 40)))[0] * np.repeat([5, 4, 3, 2], 10),
    "nearly equal": lambda rng: np.linalg.qr(rng.standard_normal((300, 40)))[0] * (1 + 1e-9 * np.arange(40)),
    "repeated column": lambda rng: np.repeat(rng.standard_normal((100, 5)), 2, axis=1),
    "diagonal": lambda rng: np.diag(np.arange(12.0))[::-1],
    "one": lambda rng: rng.standard_normal((9, 1)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_solver(name):
    a = MATRICES[name](np.random.default_rng(7))
    r = whitening._triangle(a)
    singular = np.linalg.svd(a, compute_uv=False)
    singular = np.append(singular, np.zeros(r.shape[1] - len(singular)))
    every = whitening.dqds(*whitening.bidiagonal(r)[:2])
    assert np.abs(np.sqrt(every) - singular).max() < 1e-13 * singular[0]
    values, vectors, total = whitening.directions(r, 12)
    assert abs(total / (singular**2).sum() - 1) < 1e-12
    assert len(values) == min(12, (singular > 1e-10 * singular[0]).sum())
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max() < 1e-13 * singular[0] ** 2 * len(singular)


def test_small_singular_values_keep_their_digits():
    diagonal, upper = np.logspace(0, -8, 12), np.logspace(-1, -9, 11)
    every = np.sqrt(whitening.dqds(diagonal, upper))
    product = math.prod(diagonal.tolist())
    assert abs(math.prod(every.tolist()) / product - 1) < 1e-12  # the determinant, to its last digits
