import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from textscore.operators import gram, krylov, ridge
from textscore.operators.ordering import contiguous_folds
from textscore.plans import embed


def closed_form(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


def data(spark, n=60, p=4, seed=0):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(n, p)) * rng.uniform(0.1, 3, p) + 1, rng.normal(size=n) * 2 + 5
    y += x @ rng.normal(size=p)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(n)],
                               "id int, x array<double>, y double")
    return x, y, df


@pytest.mark.parametrize("solver", ["normal", "l-bfgs"])
def test_spark_ml_matches_closed_form(spark, solver):
    x, y, df = data(spark)
    vectors = df.withColumn("features", array_to_vector("x")).cache()
    for alpha in (0.1, 10.0, 1000.0):
        model = ridge.fit_linear(vectors, alpha, solver=solver)
        w, b = closed_form(x, y, alpha)
        np.testing.assert_allclose(model.coefficients.toArray(), w, atol=1e-6)
        assert model.intercept == pytest.approx(b, abs=1e-6)


def test_constant_label(spark):
    df = spark.createDataFrame([([1.0], 3.0), ([2.0], 3.0)], "x array<double>, y double")
    model = ridge.fit_linear(df.withColumn("features", array_to_vector("x")), 1.0)
    assert model.coefficients[0] == 0 and model.intercept == 3


def test_no_convergence_is_an_error(spark):
    _, _, df = data(spark)
    with pytest.raises(ArithmeticError):
        ridge.fit_linear(df.withColumn("features", array_to_vector("x")), 0.1, solver="l-bfgs", max_iter=1)


def test_one_feature_fixture(spark):
    df = spark.createDataFrame([([1.0], 2.0), ([2.0], 3.0), ([3.0], 5.0), ([4.0], 6.0)],
                               "x array<double>, y double").withColumn("fold", F.lit(0))
    fit = ridge.solve_folds(ridge.augmented_gram(df, "x", width=1), 1, [1.0]).where("fit = -1").first()
    assert fit["weights"][0] == pytest.approx(1.1666667, abs=1e-6)
    assert fit["intercept"] == pytest.approx(1.0833333, abs=1e-6)
    assert 1 - fit["sse"] / fit["sst"] == pytest.approx(0.9527778, abs=1e-6)


def brute_force(x, y, folds, k, alpha):
    r2, mse = [], []
    for f in range(k):
        w, b = closed_form(x[folds != f], y[folds != f], alpha)
        t = y[folds == f]
        sse = ((t - x[folds == f] @ w - b) ** 2).sum()
        r2.append(1 - sse / ((t - t.mean()) ** 2).sum())
        mse.append(sse / len(t))
    w, b = closed_form(x, y, alpha)
    return (np.mean(r2), np.std(r2), np.mean(mse), np.std(mse),
            1 - ((y - x @ w - b) ** 2).sum() / ((y - y.mean()) ** 2).sum())


@pytest.mark.parametrize("sparse", [False, True])
def test_one_pass_cross_validation(spark, sparse):
    x, y, df = data(spark, 57, 5)
    folded = contiguous_folds(df, ["id"], 5)
    if sparse:
        folded = folded.withColumn("idx", F.sequence(F.lit(0), F.lit(4)))
        grams = ridge.augmented_gram(folded, "idx", width=5, values="x")
    else:
        grams = ridge.augmented_gram(folded, "x", width=5)
    got = {r["alpha"]: r for r in ridge.cv_summary(
        ridge.solve_folds(grams, 5, [0.1, 10.0]), ["alpha"]).collect()}
    folds = np.repeat(np.arange(5), [12, 12, 11, 11, 11])
    for alpha, row in got.items():
        np.testing.assert_allclose(row[1:], brute_force(x, y, folds, 5, alpha), rtol=1e-8)


def test_r2_of_constant_targets(spark):
    df = spark.createDataFrame([(0.0, 0.0, 9), (1.0, 0.0, 9), (1.0, 4.0, 9), (0.0, 0.0, 1)], "sse double, sst double, n long")
    got = [r[0] for r in df.select(ridge.r2(F.col("sse"), F.col("sst"), F.col("n"))).collect()]
    assert got == [1.0, 0.0, 0.75, None]


@pytest.mark.parametrize("blocks", [1, 5])
def test_partial_grams(spark, blocks, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(gram, "CHUNK", 7)
    x = rng.normal(size=(6, 40)) * (rng.random((6, 40)) < 0.3)
    x[4] = 0
    rows = [(int(t % 2), 1, f"t{t}", int(i), float(x[i, t])) for i in range(6) for t in range(40) if x[i, t]]
    df = spark.createDataFrame(rows, "cell int, ngram int, term string, i int, weight double")
    got = gram.gram_rows(gram.partial_grams(df, 6, ["cell"], blocks), ["cell"])
    for cell in (0, 1):
        part = np.zeros((6, 6))
        for r in got.where(F.col("cell") == cell).collect():
            part[r["i"]] = r["values"]
        half = x[:, cell::2]
        np.testing.assert_allclose(part, half @ half.T, atol=1e-12)


def test_dual_equals_primal():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 200)), rng.normal(size=30)
    train = np.arange(0, 25)
    for alpha, a, b, prediction in gram.dual_path(x @ x.T, y, train, [0.1, 5.0]):
        w, intercept = closed_form(x[train], y[train], alpha)
        np.testing.assert_allclose(prediction, x @ w + intercept, atol=1e-10)
        np.testing.assert_allclose(x[train].T @ a, w, atol=1e-10)
        assert b == pytest.approx(intercept)


def test_embedding_search(spark):
    x, y, df = data(spark, 43, 6, seed=5)
    df = df.select("id", F.col("x").cast("array<float>").alias("embedding"), F.col("y").alias("label"))
    df = df.unionByName(spark.createDataFrame([(99, None, 1.0), (98, [1.0] * 6, None)],
                                              "id int, embedding array<float>, label double"))
    fits = embed.embedding_search(df, "id", "label", alphas=[1.0])
    row = embed.embedding_scores(fits).first()
    x32 = x.astype(np.float32).astype(float)
    folds = np.repeat(np.arange(5), [9, 9, 9, 8, 8])
    np.testing.assert_allclose(row[1:], brute_force(x32, y, folds, 5, 1.0), rtol=1e-8)
    full = fits.where("fit = -1").first()
    scored = embed.score_embeddings(df.where("embedding is not null"), full).orderBy("id").collect()
    w, b = closed_form(x32, y, 1.0)
    np.testing.assert_allclose([r["prediction"] for r in scored][:43], x32 @ w + b, rtol=1e-9)


def test_embedding_lengths_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0], 1.0), (2, [1.0, 2.0], 1.0)],
                               "id int, embedding array<float>, label double")
    with pytest.raises(Exception, match="not all of"):
        embed.embedding_search(df, "id", "label", folds=2)


def test_holdout_is_stable(spark):
    df = spark.range(5000).withColumnRenamed("id", "key")
    one = embed.holdout(df, "key").where("test").count()
    assert 900 < one < 1100
    again = embed.holdout(df.repartition(7), "key").where("test").count()
    other = embed.holdout(df, "key", seed=1).where("test").join(embed.holdout(df, "key").where("test"), "key")
    assert again == one and other.count() < one / 2


@pytest.mark.parametrize("side, entries", [(1024, 1 << 20), (4, 30)])
def test_tiles_equal_dense(spark, monkeypatch, side, entries):
    """One tile, and many tiles of blocks that were cut."""
    monkeypatch.setattr(krylov, "ENTRIES", entries)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(13, 25)) * (rng.random((13, 25)) < 0.5)
    x[3] = 0
    i, t = np.nonzero(x)
    df = spark.createDataFrame(list(zip(i.tolist(), t.tolist(), x[i, t].tolist())), "i long, t long, weight double")
    got = np.zeros((13, 13))
    for r in gram.tile_products(gram.tiles(df, 13, 25, side), 13, side).collect():
        got[r["i"], r["j"]] += r["product"]
    np.testing.assert_allclose(got, np.triu(x @ x.T), atol=1e-12)
    assert gram.tile_products(gram.tiles(df.limit(0), 13, 25, side), 13, side).count() == 0


def test_wide_embeddings_equal_narrow_ones(spark, monkeypatch):
    rng = np.random.default_rng(10)
    data = [(int(k), float(rng.normal()), [float(v) for v in rng.normal(size=6)]) for k in range(40)]
    df = spark.createDataFrame(data, "key int, y double, embedding array<double>")
    narrow = {(r["fit"], r["alpha"]): r for r in embed.embedding_search(df, "key", "y", alphas=(0.5, 5.0)).collect()}
    monkeypatch.setattr(ridge, "MAX_SIDE", 4)
    wide = {(r["fit"], r["alpha"]): r for r in embed.embedding_search(df, "key", "y", alphas=(0.5, 5.0)).collect()}
    assert set(wide) == set(narrow)
    for key, row in wide.items():
        np.testing.assert_allclose([row[c] for c in ("n", "sse", "sst", "intercept")],
                                   [narrow[key][c] for c in ("n", "sse", "sst", "intercept")], rtol=1e-6, atol=1e-8)
    full = wide[ridge.FULL, 5.0]
    np.testing.assert_allclose(full["weights"], narrow[ridge.FULL, 5.0]["weights"], atol=1e-7)
    scored = embed.score_embeddings(df, full).first()
    assert scored["prediction"] == pytest.approx(np.dot(scored["embedding"], full["weights"]) + full["intercept"])
    bad = df.unionByName(spark.createDataFrame([(99, 1.0, [1.0])], df.schema))
    with pytest.raises(ValueError, match="not all of 6"):
        embed.embedding_search(bad, "key", "y")
