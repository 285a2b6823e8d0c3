import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textscore.operators import gram, grid, krylov, ridge
from textscore.plans import report, search
from textscore.sources import writers

GRID = dict(min_df=(2, 50), max_df=(0.5, 0.9), max_ngram=(1, 2), alphas=(0.1, 10.0), min_vocab=5)


def corpus(spark, speakers=17, seed=7):
    rng = random.Random(seed)
    words = [a + b for a in "abcd" for b in "efgh"]
    ads = [[rng.choice(words) for _ in range(rng.randrange(0, 12))] for _ in range(40)]
    speeches = []
    for i in range(speakers * 3):
        who = rng.randrange(speakers)
        speeches.append((f"k{who:02}", i, who * 0.3 - 2 + (who % 3), [rng.choice(words + ["zz"]) for _ in range(rng.randrange(0, 9))]))
    speeches += [("none", 900, None, ["ae"]), (None, 901, 1.0, ["ae"]), ("quiet", 902, 0.4, ["zz"]),
                 ("silent", 903, -0.4, [])]
    return (ads, speeches,
            spark.createDataFrame([(a,) for a in ads], "tokens array<string>"),
            spark.createDataFrame(speeches, "unique_id string, speech_id int, dime double, tokens array<string>"))


def grams(tokens, n):
    return [" ".join(tokens[i:i + m]) for m in range(1, n + 1) for i in range(len(tokens) - m + 1)]


def matrix(ads, speeches, min_df, max_df, ngram, limit=None):
    """TF-IDF rows of the scored speakers in key order, by plain loops."""
    df = Counter(t for a in ads for t in set(grams(a, ngram)))
    cf = Counter(t for a in ads for t in grams(a, ngram))
    vocabulary = [t for t, d in df.items() if min_df <= d <= max_df * len(ads)]
    vocabulary = sorted(sorted(vocabulary, key=lambda t: (-cf[t], t))[:limit])
    column = {t: j for j, t in enumerate(vocabulary)}
    target, tokens = {}, {}
    for key, _, dime, words in sorted((s for s in speeches if s[0]), key=lambda s: (s[0], s[1])):
        tokens.setdefault(key, []).extend(words)
        if dime is not None:
            target.setdefault(key, dime)
    keys = sorted(target)
    x = np.zeros((len(keys), len(vocabulary)))
    for i, key in enumerate(keys):
        for t, c in Counter(grams(tokens[key], ngram)).items():
            if t in column:
                x[i, column[t]] = c * (np.log((1 + len(ads)) / (1 + df[t])) + 1)
        length = np.sqrt((x[i] ** 2).sum())
        x[i] /= length or 1
    return keys, vocabulary, x, np.array([target[k] for k in keys])


def fit(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


def scores(x, y, alpha, k=5):
    sizes = [len(y) // k + (f < len(y) % k) for f in range(k)]
    folds = np.repeat(np.arange(k), sizes)
    r2, mse = [], []
    for f in range(k):
        w, b = fit(x[folds != f], y[folds != f], alpha)
        t = y[folds == f]
        sse = ((t - x[folds == f] @ w - b) ** 2).sum()
        r2.append(1 - sse / ((t - t.mean()) ** 2).sum())
        mse.append(sse / len(t))
    w, b = fit(x, y, alpha)
    return (np.mean(r2), np.std(r2), np.mean(mse), np.std(mse),
            1 - ((y - x @ w - b) ** 2).sum() / ((y - y.mean()) ** 2).sum())


@pytest.mark.parametrize("route", ["kernel", "krylov"])
def test_search_equals_brute_force(spark, monkeypatch, route, tmp_path):
    """Both ways to fit on one corpus, against dense matrices."""
    monkeypatch.setattr(ridge, "MAX_SIDE", {"kernel": 4096, "krylov": 1}[route])
    params = dict(GRID)
    ads, speeches, ads_df, speeches_df = corpus(spark)
    found = search.grid_search(ads_df, speeches_df, **params)
    results = found.results.orderBy("grid_pos").collect()
    points = [(m, s, g, a) for m in params["min_df"] for s in params["max_df"]
              for g in params["max_ngram"] for a in params["alphas"]]
    assert [(r["min_df"], r["max_df"], r["max_ngram"], r["ridge_alpha"]) for r in results] == points
    tolerance = 1e-6 if route == "krylov" else 1e-8
    best = None
    for row, (min_df, max_df, ngram, alpha) in zip(results, points):
        keys, vocabulary, x, y = matrix(ads, speeches, min_df, max_df, ngram)
        if len(vocabulary) < params["min_vocab"]:
            assert not row["success"] and row["error"].startswith("TF-IDF failure: ")
            assert (row["vocab_size"], row["cv_r2_mean"], row["cv_mse_mean"]) == (0, -999.0, 999.0)
            continue
        expected = scores(x, y, alpha)
        got = [row[c] for c in ("cv_r2_mean", "cv_r2_std", "cv_mse_mean", "cv_mse_std", "train_r2")]
        np.testing.assert_allclose(got, expected, rtol=tolerance)
        assert row["success"] and row["error"] is None and row["vocab_size"] == len(vocabulary)
        if best is None or expected[0] > best[0]:
            best = (expected[0], min_df, max_df, ngram, alpha)
    assert (found.best["min_df"], found.best["max_df"], found.best["max_ngram"], found.best["ridge_alpha"]) == best[1:]

    keys, vocabulary, x, y = matrix(ads, speeches, *best[1:4])
    w, b = fit(x, y, best[4])
    terms = {r["term"]: r["coefficient"] for r in found.model.terms.collect()}
    assert sorted(terms) == vocabulary
    np.testing.assert_allclose([terms[t] for t in vocabulary], w, atol=tolerance)
    assert found.model.params.first()["intercept"] == pytest.approx(b, abs=tolerance)

    writers.save_model(found.model, str(tmp_path / "model"))
    model = writers.load_model(spark, str(tmp_path / "model"))
    predicted = {r["unique_id"]: r["prediction"] for r in model.predict(speeches_df, "unique_id", ["speech_id"]).collect()}
    np.testing.assert_allclose([predicted[k] for k in keys], x @ w + b, atol=tolerance)
    assert set(predicted) == {*keys, "none"}


@pytest.mark.parametrize("route", ["kernel", "krylov"])
def test_limited_vocabularies_equal_brute_force(spark, monkeypatch, route):
    monkeypatch.setattr(ridge, "MAX_SIDE", {"kernel": 4096, "krylov": 1}[route])
    ads, speeches, ads_df, speeches_df = corpus(spark)
    params = dict(min_df=(2, 12), max_df=(0.9,), max_ngram=(1, 2), max_features=(6, 30, None), alphas=(1.0,), min_vocab=5)
    found = search.grid_search(ads_df, speeches_df, **params)
    points = [(m, 0.9, g, k) for m in (2, 12) for g in (1, 2) for k in (6, 30, None)]
    results = found.results.orderBy("grid_pos").collect()
    assert [(r["min_df"], r["max_df"], r["max_ngram"], r["max_features"]) for r in results] == points
    best = None
    for row, point in zip(results, points):
        keys, vocabulary, x, y = matrix(ads, speeches, *point)
        assert row["vocab_size"] == len(vocabulary) and row["success"]
        expected = scores(x, y, 1.0)
        np.testing.assert_allclose([row["cv_r2_mean"], row["train_r2"]], [expected[0], expected[4]], rtol=1e-6)
        if best is None or expected[0] > best[0] + 1e-9:
            best = (expected[0], point)
    assert tuple(found.best[c] for c in ("min_df", "max_df", "max_ngram", "max_features")) == best[1]
    keys, vocabulary, x, y = matrix(ads, speeches, *best[1])
    assert sorted(r["term"] for r in found.model.terms.collect()) == vocabulary


def test_too_few_speakers_fail_each_point(spark):
    _, _, ads, speeches = corpus(spark)
    few = speeches.where("unique_id in ('k00', 'k01')")
    prepared = search.prepare(ads, few, ["speech_id"], grid.Grid([2], [0.9], [1]), 5)
    rows = search.cross_validate(prepared, (1.0, 2.0), 5, 5).collect()
    assert len(rows) == 2 and not any(r["success"] for r in rows)
    assert all(r["vocab_size"] > 0 and "n_splits=5" in r["error"] for r in rows)


def test_missing_columns(spark):
    _, _, ads, speeches = corpus(spark)
    with pytest.raises(ValueError, match="dime"):
        search.grid_search(ads, speeches.drop("dime"))


def test_nothing_succeeds(spark):
    _, _, ads, speeches = corpus(spark)
    with pytest.raises(ValueError):
        search.grid_search(ads, speeches, min_df=(1000,), max_df=(0.9,), max_ngram=(1,))


def test_config_without_any_known_term(spark):
    _, _, ads, speeches = corpus(spark)
    mute = speeches.withColumn("tokens", F.array(F.lit("zz")))
    found = search.grid_search(ads, mute, min_df=(2,), max_df=(0.9,), max_ngram=(1,), alphas=(1.0,), min_vocab=5)
    assert found.results.first()["train_r2"] == pytest.approx(0.0, abs=1e-12)


def results(spark):
    rows = [(0, 2, 0.1, 1.0, 60, 0.3, True), (1, 2, 0.1, 10.0, 60, 0.5, True), (2, 5, 0.3, 1.0, 80, 0.5, True),
            (3, 5, 0.3, 10.0, 80, 0.1, True), (4, 100, 0.1, 1.0, 0, -999.0, False)]
    return spark.createDataFrame(rows, "grid_pos int, min_df int, max_df double, ridge_alpha double, "
                                       "vocab_size long, cv_r2_mean double, success boolean")


def test_report(spark, rows):
    parts = report.report(results(spark))
    assert rows(parts["totals"]) == [(5, 4, 1)]
    assert [r["grid_pos"] for r in parts["top"].collect()] == [1, 2, 0, 3]
    got = rows(parts["breakdowns"])
    assert got == [
        ("max_df", 0.1, 0.4, 0.5, 60.0, 2), ("max_df", 0.3, 0.3, 0.5, 80.0, 2),
        ("min_df", 2.0, 0.4, 0.5, 60.0, 2), ("min_df", 5.0, 0.3, 0.5, 80.0, 2),
        ("ridge_alpha", 1.0, 0.4, 0.5, None, 2), ("ridge_alpha", 10.0, 0.3, 0.5, None, 2)]
    assert search.best_config(results(spark))["grid_pos"] == 1


@pytest.mark.parametrize("route", ["kernel", "krylov"])
def test_a_failed_fit_is_a_row(spark, monkeypatch, route):
    """One config's fits fail: its points are failures with their error, the rest of the grid stays."""
    monkeypatch.setattr(ridge, "MAX_SIDE", {"kernel": 4096, "krylov": 1}[route])
    ads, speeches, ads_df, speeches_df = corpus(spark)
    _, vocabulary, x, _ = matrix(ads, speeches, 2, 0.9, 2)
    if route == "kernel":
        real, broken = gram.dual_path, float((x @ x.T).sum())

        def dual_path(kernel, y, train, alphas):
            if abs(kernel.sum() - broken) < 1e-6:
                raise ArithmeticError("broken")
            return real(kernel, y, train, alphas)

        monkeypatch.setattr(gram, "dual_path", dual_path)
    else:
        real = krylov.solve

        def solve(own, alphas):
            terms = own.terms.agg(F.sum(F.length("member"))).first()[0] // (8 * own.sizes.groups)
            if own.sizes.folds and terms == len(vocabulary):
                raise ArithmeticError("broken")
            return real(own, alphas)

        monkeypatch.setattr(krylov, "solve", solve)
    params = {**GRID, "min_df": (2,), "max_df": (0.9,), "max_ngram": (1, 2), "alphas": (1.0, 10.0)}
    found = search.grid_search(ads_df, speeches_df, **params)
    rows = found.results.orderBy("grid_pos").collect()
    lost = [r for r in rows if not r["success"]]
    assert len(rows) == 4 and {r["max_ngram"] for r in lost} == {2} and len(lost) == 2
    assert {r["error"] for r in lost} == {"Ridge failure: ArithmeticError: broken"}
    assert {(r["cv_r2_mean"], r["cv_mse_mean"], r["vocab_size"]) for r in lost} == {(-999.0, 999.0, len(vocabulary))}
    assert found.best["max_ngram"] == 1


def test_unsolved_alphas_are_failures(spark, monkeypatch):
    """Too few steps: an alpha that is not solved is a failure, a solved one stays."""
    monkeypatch.setattr(ridge, "MAX_SIDE", 1)
    real = krylov.solve
    monkeypatch.setattr(krylov, "solve", lambda own, alphas: real(own, alphas, max_steps=3 if own.sizes.folds else 1000))
    _, _, ads_df, speeches_df = corpus(spark)
    params = {**GRID, "min_df": (2,), "max_df": (0.9,), "max_ngram": (1,), "alphas": (1e-3, 1e6)}
    lost, kept = search.grid_search(ads_df, speeches_df, **params).results.orderBy("ridge_alpha").collect()
    assert lost["error"] == "Ridge failure: ArithmeticError: no convergence" and not lost["success"]
    assert kept["success"] and kept["error"] is None
