import numpy as np
import pytest

from pyspark.sql import functions as F

from textscore.operators import krylov
from textscore.operators.ridge import FULL


def dense(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


def tables(spark, x, y, folds, scale, member):
    i, t = np.nonzero(x)
    entries = spark.createDataFrame(list(zip(i.tolist(), t.tolist(), x[i, t].tolist())), "i long, t long, weight double")
    rows = spark.createDataFrame([(k, float(y[k]), int(folds[k]), [float(s) for s in scale[k]]) for k in range(len(y))],
                                 "i long, y double, fold int, scale array<double>")
    terms = spark.createDataFrame([(k, [float(m) for m in member[k]]) for k in range(x.shape[1])],
                                  "t long, member array<double>")
    return entries, rows, terms


def check(spark, x, y, folds, k, scale, member, alphas, tolerance=1e-7):
    groups = scale.shape[1]
    own = krylov.problem(*tables(spark, x, y, folds, scale, member), k, groups)
    found = krylov.solve(own, alphas)
    assert found.solved.all()
    errors = {(r["group"], r["alpha"], r["fit"]): r for r in found.errors().collect()}
    for g in range(groups):
        xg = scale[:, g, None] * x * member[:, g]
        for alpha in alphas:
            for fit in [*range(k), FULL]:
                train, test = (folds != fit, folds == fit) if fit != FULL else (slice(None), slice(None))
                w, b = dense(xg[train], y[train], alpha)
                miss = ((y[test] - xg[test] @ w - b) ** 2).sum()
                got = errors[g, alpha, fit]
                assert got["n"] == len(y[test])
                assert got["sse"] == pytest.approx(miss, rel=1e-5, abs=1e-9)
                assert got["sst"] == pytest.approx(((y[test] - y[test].mean()) ** 2).sum(), rel=1e-9, abs=1e-9)
            got = {r["t"]: r["coefficient"] for r in found.coefficients(g, alpha).collect()}
            np.testing.assert_allclose([got[t] for t in range(x.shape[1])], w, atol=tolerance)
            assert found.intercept(g, alpha) == pytest.approx(b, abs=tolerance)
    return found


@pytest.mark.parametrize("cells, entries", [(1 << 20, 1 << 20), (100, 20)])
def test_equals_dense(spark, monkeypatch, cells, entries):
    """One chunk, and many small chunks and cut blocks; two groups with scales and members of their own."""
    monkeypatch.setattr(krylov, "CELLS", cells)
    monkeypatch.setattr(krylov, "ENTRIES", entries)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(41, 14)) * (rng.random((41, 14)) < 0.4)
    x[7] = 0
    y = rng.normal(size=41) + x[:, 0]
    scale = np.stack([np.ones(41), rng.random(41) + 0.5], 1)
    member = np.stack([np.ones(14), (np.arange(14) % 3 > 0) * 1.0], 1)
    check(spark, x, y, np.arange(41) * 3 // 41, 3, scale, member, [0.1, 10.0])


def test_more_terms_than_rows_and_constant_targets(spark):
    rng = np.random.default_rng(6)
    x = rng.random((9, 60))
    one = np.ones((9, 1)), np.ones((60, 1))
    check(spark, x, rng.normal(size=9), np.arange(9) // 3, 3, *one, [0.01, 1.0])
    check(spark, x, np.full(9, 2.5), np.arange(9) // 3, 3, *one, [1.0])


def test_no_terms_used(spark):
    x = np.zeros((6, 2))
    y = np.arange(6.0)
    entries, rows, terms = tables(spark, x + np.eye(6, 2), y, np.arange(6) // 3, np.ones((6, 1)), np.ones((2, 1)))
    found = krylov.solve(krylov.problem(entries.limit(0), rows, terms, 2), [1.0])
    full = found.errors().filter(F.col("fit") == FULL).first()
    assert full["sse"] == pytest.approx(full["sst"]) and found.solved.all()
    assert found.intercept(0, 1.0) == pytest.approx(2.5)


def test_too_few_steps_are_not_solved(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(30, 20))
    own = krylov.problem(*tables(spark, x, rng.normal(size=30), np.arange(30) // 10, np.ones((30, 1)), np.ones((20, 1))), 3)
    found = krylov.solve(own, [1e-3, 1e6], max_steps=2)
    assert not found.solved[:, 0].any() and found.solved[:, 1].all()
    with pytest.raises(ValueError, match="positive"):
        krylov.solve(own, [0.0])
