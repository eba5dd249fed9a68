import math
import random

import numpy as np
import pytest

from starmill.llm import whitening

COLUMNS = "vec_id bigint, embedding array<float>, n string, component int, x double"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 9, 0.5) for i, v in rows], COLUMNS)


def scaled(rows):
    """(ids, integer entries) of the rows that take part, by the definition."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    return [i for i, _ in good], [v + [1_000_000] * (width - len(v)) for _, v in good]


def covariance(x):
    mean = np.array([sum(c) / len(x) for c in zip(*x, strict=True)])
    apart = np.array(x, float) - mean
    return apart, apart.T @ apart / len(x)


def by_row(got, n_rows):
    """component -> whitened values in the order of the ids 0..n-1."""
    made = {}
    for r in got:
        made.setdefault(r.component, {})[r.vec_id] = r.whitened
    return np.array([[made[c][i] for c in sorted(made)] for i in range(n_rows)])


def test_components_against_a_dense_solution(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(c) for c in rng.normal(0, np.linspace(0.5, 3, 12))]) for k in range(500)]
    got = whitening.whiten(rows_of(spark, rows), k=5).collect()
    ids, x = scaled(rows)
    apart, v = covariance(x)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    want = apart @ vectors[:, :5] / np.sqrt(values[:5])
    made = by_row(got, 500)
    made *= np.sign((made * want).sum(0))
    assert np.abs(made - want).max() < 1e-9
    sums = [sum(c) for c in zip(*x, strict=True)]
    for r in got:
        assert r.n == 500 and r.identity_error < 1e-10
        assert abs(r.explained - values[r.component - 1] / v.trace()) < 1e-12
        assert r.deviation == sum((500 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums, strict=True))


def test_many_more_dimensions_than_components_settle_to_rounding():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 250)) * np.linspace(3, 1, 250)
    v = x.T @ x / 3000
    values, vectors = whitening.eigenpairs(lambda w: v @ w, 250, 20)
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:20]).max() < 1e-12 * values[0]
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 1e-12 * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-12


@pytest.mark.parametrize("values", [[1.0] * 30 + [0.0] * 20, [5.0, 5.0, 5.0, 1.0, 0.0], [2.0], [0.0, 0.0, 0.0]])
def test_repeated_and_zero_eigenvalues(values):
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))[0]
    v = turn * values @ turn.T
    got, vectors = whitening.eigenpairs(lambda w: v @ w, len(values), 8)
    assert np.allclose(got, sorted(values, reverse=True)[:8], atol=1e-13)
    assert np.abs(vectors.T @ vectors - np.eye(vectors.shape[1])).max() < 1e-12


def test_minres_solves_an_indefinite_system():
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((9, 9)))[0]
    a = turn * [-3, -2, -1, 1, 2, 3, 4, 5, 6] @ turn.T
    right = rng.standard_normal((9, 4))
    assert np.allclose(a @ whitening.minres(lambda t: a @ t, right, 9), right, atol=1e-8)


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(40)]
    clean = rows + [(7, rows[7][1]), (None, rows[3][1]), (50, []), (51, [1.0, 2.0])]
    bad = [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (63, [float("-inf"), 0.0, 0.0, 0.0])]
    got = whitening.whiten(rows_of(spark, clean + bad)).collect()
    assert len(got) == 4 * len(clean) and {r.n for r in got} == {len(clean)}
    assert sorted({str(r.vec_id) for r in got}) == sorted({str(i) for i, _ in clean})
    _, v = covariance(scaled(clean)[1])
    shares = {r.component: r.explained for r in got}
    assert np.allclose([shares[c] for c in (1, 2, 3, 4)], np.linalg.eigvalsh(v)[::-1] / v.trace(), atol=1e-12)
    assert abs(sum(r.whitened ** 2 for r in got) / len(clean) - 4) < 1e-9


def test_a_constant_dimension_has_no_whitened_values(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1), 0.5, rng.gauss(0, 1)]) for k in range(30)]
    got = whitening.whiten(rows_of(spark, rows)).collect()
    assert all((r.whitened is None) == (r.component == 3) and r.identity_error < 1e-10 for r in got)
    assert {r.explained for r in got if r.component == 3} == {0.0}


def test_equal_rows_one_row_and_no_rows(spark):
    got = whitening.whiten(rows_of(spark, [(1, [1.0, 2.0])] * 3)).collect()
    assert len(got) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 for r in got)
    assert whitening.whiten(rows_of(spark, [(1, None)])).collect() == []
    assert whitening.whiten(rows_of(spark, [(1, [])])).collect() == []
    assert whitening.whiten(rows_of(spark, [])).dtypes == got_types()


def got_types():
    return [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"),
            ("explained", "double"), ("identity_error", "double")]


def test_too_large_entries_are_refused(spark):
    with pytest.raises(OverflowError):
        whitening.whiten(rows_of(spark, [(k, [1e17, 0.0]) for k in range(4)]))
