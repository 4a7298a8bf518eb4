"""Whitening: moments and projections against exact arithmetic, eigenvectors by residuals."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from plantlog.llm import whitening
from tests.llm.texts import SF

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 0, "x", "i") for i, v in rows], schema)


def expected(rows):
    """Per row: n, exact deviation, centred vector, and the exact covariance of the distinct vectors."""
    good = [(i, [floor(256 * c) for c in v]) for i, v in rows
            if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    centred = [[Fraction(n * x[j] - s[j], n) for j in range(d)] for x in fit]
    v = [[sum(c[a] * c[b] for c in centred) / n for b in range(d)] for a in range(d)]
    return n, {i: (sum((n * c - t) ** 2 for c, t in zip(x, s)), [Fraction(n * c - t, n) for c, t in zip(x, s)])
               for i, x in good}, v


def vectors(seed, n=300, d=6, spread=(9, 4, 2, 1, .5, .1), shift=3):
    r = np.random.default_rng(seed)
    q = np.linalg.qr(r.normal(size=(d, d)))[0]
    return [np.float32(v).tolist() for v in r.normal(size=(n, d)) * spread[:d] @ q.T + shift]


def test_whitening_equals_exact_moments(spark):
    v = vectors(1)
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6)]
    rows = [(i, x) for i, x in enumerate(v)] + [(500 + i % 3, v[0]) for i in range(40)]
    got = whitening.whiten(frame(spark, rows + odd).repartition(5)).collect()
    n, rowwise, cov = expected(rows)
    assert len(got) == 4 * len(rows) and {r.vec_id for r in got} == {i for i, _ in rows}
    e, axes = np.linalg.eigh(np.array(cov, float))
    e, axes = e[::-1], axes[:, ::-1]
    signs = {}
    for r in got:
        deviation, y = rowwise[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation)
        want = float(np.array(y, float) @ axes[:, r.component - 1] / e[r.component - 1] ** .5)
        signs.setdefault(r.component, np.sign(want * r.whitened) if abs(want) > .1 else None)
        if signs[r.component]:
            assert r.whitened == pytest.approx(signs[r.component] * want, rel=1e-11, abs=1e-11)
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-12)
        assert r.identity_error < 1e-12


@pytest.mark.parametrize("values", [
    [5, 5 - 1e-9, 5 - 2e-9, 1, .1], [1, 1, 1, 1, 1], [4, 3, 2, 1, 0], [1, 1 - 1e-5, .5, .5 - 1e-13, 1e-6], [7],
    [1, 1e-4, 1e-8, 1e-12, 1e-16], [3, 3, 3 - 1e-6, 3 - 1e-6, 2]])
def test_refined_eigenvectors_of_clusters(values):
    d = len(values)
    q = whitening._orthonormal(np.random.default_rng(d).normal(size=(d, d)).astype(np.longdouble))
    a = (q * np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    e, x = whitening.refined(a)
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-17
    assert np.abs(a @ x - x * e).max() < 1e-16 * max(values)
    assert np.abs(e - np.sort(np.array(values, np.longdouble))[::-1]).max() < 1e-16 * max(values)
    gaps = np.abs(np.diff(e))
    if d > 1 and (gaps > 1e-10).all():
        # Vectors themselves, to double precision over the relative gap.
        order = np.argsort(-np.array(values))
        assert np.abs(np.abs((q[:, order] * x).sum(axis=0)) - 1).max() < 1e-15


def test_refinement_beats_float32_and_float64_in_a_cluster():
    values = [1, 1 - 1e-8, .5, .25]
    q = whitening._orthonormal(np.random.default_rng(2).normal(size=(4, 4)).astype(np.longdouble))
    a = (q * np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    off = lambda x: np.abs(np.abs((q * x).sum(axis=0)) - 1).max()
    assert off(whitening.refined(a)[1]) < 1e-18 < off(np.linalg.eigh(a.astype(np.float64))[1][:, ::-1])


def test_defined_results(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])])).collect()
    assert len(one) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in one)
    # Two lengths are two populations; the flat one has a component without variance.
    got = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0]), (4, [4.0])])).collect()
    assert {(r.vec_id, r.component): r.whitened if r.whitened is None else round(abs(r.whitened), 12) for r in got} == {
        (1, 1): 1, (2, 1): 1, (1, 2): None, (2, 2): None, (3, 1): 1, (4, 1): 1}
    big = "vec_id long, embedding array<double>, label int, x string, id string"
    huge = whitening.whiten(frame(spark, [(1, [1e307, 1.0]), (2, [-1e30, 2.0]), (3, [1e15, 0.0])], big)).collect()
    assert len(huge) == 6 and all(r.deviation is None and r.identity_error < 1e-4 for r in huge)
    assert {r.n for r in huge} == {3}


def test_registered_query(spark):
    from plantlog.llm.queries import QUERIES
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = QUERIES["op12_whitening"](spark, SF).collect()
    assert len(got) == 4 * len(table)
    n, rowwise, _ = expected([(r.vec_id, r.embedding) for r in table])
    assert all((r.n, r.deviation) == (n, rowwise[r.vec_id][0]) for r in got)
    assert max(r.identity_error for r in got) < 1e-10
