"""Ridge regression with a free intercept: min |y - Xw - b|^2 + alpha |w|^2.

* Few features: one pass sums an augmented Gram matrix per fold. Every training set is a
  sum of folds, so all folds and alphas come from that pass, and so do their errors.
* Few rows: the rows' Gram matrix, see `gram.py`.
* Any size: a basis shared by all alphas, see `krylov.py`. The first two are shortcuts to the same
  numbers where a matrix of `MAX_SIDE` rows fits a task; tests hold all routes equal.
* `fit_linear`: Spark ML's model, checked for convergence.
"""

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from textscore.sources.work import materialise

FULL = -1
MAX_SIDE = 4096


def sum_arrays(df, keys, column="values"):
    """Elementwise sum of equally long arrays per key, combined map-side."""
    total = Summarizer.sum(array_to_vector(F.col(column)))
    return df.groupBy(*keys).agg(vector_to_array(total).alias(column))


def augmented_gram(df, features, label="y", fold="fold", width=None, values=None):
    """(fold, i, values): rows of M'M for M = [1, x, y], per fold.

    `features` is a dense array of `width` numbers, or with `values` the indices of a sparse
    one. A task holds one small matrix per fold, whatever the number of rows. The sums are
    written down: they are read several times, the table behind them once.
    """
    size = width + 2
    columns = [F.col(fold).alias("fold"), F.col(label).cast("double").alias("y"),
               F.col(features).alias("x")]
    if values:
        columns.append(F.col(values).alias("v"))
    else:
        columns[2] = F.col(features).cast("array<double>").alias("x")

    def partial(batches):
        sums = {}
        for pdf in batches:
            for f, part in pdf.groupby("fold"):
                m = np.zeros((len(part), size))
                m[:, 0], m[:, -1] = 1.0, part["y"]
                if not values and any(len(x) != width for x in part["x"]):
                    raise ValueError(f"vectors are not all of {width} numbers")
                if values:
                    at = np.repeat(np.arange(len(part)), [len(x) for x in part["x"]])
                    m[at, 1 + np.concatenate(part["x"].to_list()).astype(int)] = np.concatenate(
                        part["v"].to_list())
                else:
                    m[:, 1:-1] = np.stack(part["x"].to_list())
                sums[f] = sums.get(f, 0.0) + m.T @ m
        for f, gram in sums.items():
            yield pd.DataFrame({"fold": f, "i": np.arange(size), "values": list(gram)})

    parts = df.select(*columns).mapInPandas(partial, "fold int, i int, values array<double>")
    return materialise(sum_arrays(parts, ["fold", "i"]), "grams")


def _square(pdf):
    return np.stack(pdf.sort_values("i")["values"].to_list())


def solve_folds(gram, folds, alphas):
    """(fit, alpha, n, sse, sst, intercept, weights) for each fold held out, and for `FULL`.

    `fit` names the fold held out and tested on; `FULL` trains and tests on all rows.
    """
    others = F.array([F.lit(f) for f in range(folds)] + [F.lit(FULL)])
    fits = F.filter(others, lambda k: k != F.col("fold"))
    train = sum_arrays(gram.select(F.explode(fits).alias("fit"), "i", "values"), ["fit", "i"])
    test = gram.select(F.col("fold").alias("fit"), F.col("i").alias("i"), "values")
    test = test.unionByName(train.where(F.col("fit") == FULL))
    alphas = [float(a) for a in alphas]

    schema = ("fit int, alpha double, n long, sse double, sst double, intercept double, "
              "weights array<double>")

    def solve(train_rows, test_rows):
        if train_rows.empty or test_rows.empty:  # all rows in one fold, or a fold without rows
            return pd.DataFrame(columns=["fit", "alpha", "n", "sse", "sst", "intercept", "weights"])
        a, t = _square(train_rows), _square(test_rows)
        n, sx, sy = a[0, 0], a[0, 1:-1], a[0, -1]
        spread = a[1:-1, 1:-1] - np.outer(sx, sx) / n
        slope = a[1:-1, -1] - sx * sy / n
        lam, u = np.linalg.eigh(spread)
        out = []
        for alpha in alphas:
            w = u @ ((u.T @ slope) / (np.maximum(lam, 0.0) + alpha))
            b = (sy - sx @ w) / n
            v = np.concatenate([[-b], -w, [1.0]])
            out.append({
                "fit": int(train_rows["fit"].iloc[0]), "alpha": alpha, "n": int(t[0, 0]),
                "sse": max(float(v @ t @ v), 0.0),
                "sst": max(float(t[-1, -1] - t[0, -1] ** 2 / t[0, 0]), 0.0),
                "intercept": float(b), "weights": w})
        return pd.DataFrame(out)

    return train.groupBy("fit").cogroup(test.groupBy("fit")).applyInPandas(solve, schema)


def r2(sse, sst, n):
    """1 - SSE/SST; with a constant target 1 if it is met exactly, else 0; none for one row."""
    return F.when(n < 2, None).when(sst > 0, 1 - sse / F.nullif(sst, F.lit(0.0))).otherwise(
        F.when(sse == 0, 1.0).otherwise(0.0))


def errors(predictions, keys):
    """Per key n, sse and sst of columns `y` and `prediction`."""
    miss = F.col("y") - F.col("prediction")
    return predictions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(miss * miss).alias("sse"),
        F.regr_syy("y", "y").alias("sst"))


def cv_summary(fold_errors, keys):
    """Mean and population deviation over the folds, and R2 on the training rows."""
    scored = fold_errors.select(*keys, "fit", r2(F.col("sse"), F.col("sst"), F.col("n")).alias("r2"),
                                (F.col("sse") / F.col("n")).alias("mse"))
    held = F.col("fit") != FULL
    return scored.groupBy(*keys).agg(
        F.avg(F.when(held, F.col("r2"))).alias("cv_r2_mean"),
        F.stddev_pop(F.when(held, F.col("r2"))).alias("cv_r2_std"),
        F.avg(F.when(held, F.col("mse"))).alias("cv_mse_mean"),
        F.stddev_pop(F.when(held, F.col("mse"))).alias("cv_mse_std"),
        F.max(F.when(~held, F.col("r2"))).alias("train_r2"))


def reg_param(alpha, n, label_variance_pop, solver):
    """Spark ML's penalty for a given alpha: it is relative to the label's deviation, by n
    rows for the normal equations and by n - 1 for the iterative solver."""
    variance = label_variance_pop if solver == "normal" else label_variance_pop * n / max(n - 1, 1)
    return alpha * variance ** 0.5 / n


def fit_linear(df, alpha, features="features", label="y", solver="normal", max_iter=2000,
               tol=1e-12):
    """Spark ML's model for one set of training rows.

    An iterative fit that used up its iterations is an error, not a result.
    """
    n, variance = df.agg(F.count("*"), F.coalesce(F.var_pop(label), F.lit(0.0))).first()
    model = LinearRegression(
        featuresCol=features, labelCol=label, elasticNetParam=0.0, standardization=False,
        fitIntercept=True, solver=solver, maxIter=max_iter, tol=tol,
        regParam=reg_param(alpha, n, variance, solver)).fit(df)
    if variance > 0 and model.summary.totalIterations >= max_iter:
        raise ArithmeticError(f"no convergence within {max_iter} iterations")
    return model
