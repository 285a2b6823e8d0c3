"""Ridge on given embeddings, scoring, and a hold-out split by key."""

import numpy as np
from pyspark.sql import functions as F

from textscore import settings
from textscore.operators import krylov, ridge
from textscore.operators.ordering import contiguous_folds, row_index
from textscore.sources.work import materialise


def dimension(df, column="embedding"):
    """Length of the first vector; that all have it is checked while they are summed."""
    return df.select(F.size(column)).first()[0]


def embedding_search(df, key, target, column="embedding", alphas=settings.EMBEDDING_ALPHAS,
                     folds=settings.FOLDS):
    """Fits of all folds and alphas, (fit, alpha, n, sse, sst, intercept, weights).

    Folds run over the rows in key order. The table is read once for the sums, however many
    folds and alphas there are.
    """
    known = df.select(key, F.col(target).cast("double").alias("y"), column).na.drop()
    if known.isEmpty():
        raise ValueError("no row has a key, a target and an embedding")
    width = dimension(known, column)
    folded = contiguous_folds(known, [key], folds)
    if width > ridge.MAX_SIDE:
        return wide_search(folded, [key], column, width, folds, alphas)
    return ridge.solve_folds(ridge.augmented_gram(folded, column, width=width), folds, alphas)


def wide_search(folded, order, column, width, folds, alphas):
    """The same fits for vectors whose products do not fit a task. A row of weights is as long as a vector.

    Weights are given for the fits on all rows; a fit that is not solved has no row.
    """
    rows = materialise(row_index(folded, order, "i"), "embedding-rows")
    if rows.where((F.size(column) != width) | F.col(column).isNull()).limit(1).count():
        raise ValueError(f"vectors are not all of {width} numbers")
    entries = rows.select("i", F.posexplode(column).alias("t", "weight")).where("weight <> 0")
    one = F.array(F.lit(1.0))
    names = rows.sparkSession.range(width).select(F.col("id").alias("t"), one.alias("member"))
    found = krylov.solve(krylov.problem(entries, rows.select("i", "y", "fold", one.alias("scale")), names, folds), alphas)
    lost = found.unsolved()
    pairs = F.array_sort(F.collect_list(F.struct("t", "coefficient")))
    fits = None
    for alpha in [float(a) for a in alphas if (0, float(a)) not in lost]:
        weights = found.coefficients(0, alpha).agg(F.transform(pairs, lambda p: p["coefficient"]).alias("weights"))
        full = weights.select(F.lit(ridge.FULL).alias("fit"), F.lit(alpha).alias("alpha"), "weights")
        fits = full if fits is None else fits.unionByName(full)
    errors = materialise(found.errors().drop("group"), "embedding-errors")
    if fits is None:
        return errors.limit(0).select("*", F.lit(None).cast("double").alias("intercept"),
                                      F.lit(None).cast("array<double>").alias("weights"))
    levels = rows.sparkSession.createDataFrame(
        [(f, float(a), found.intercept(0, float(a), f)) for f in [*range(folds), ridge.FULL] for a in alphas
         if (0, float(a)) not in lost], "fit int, alpha double, intercept double")
    return errors.join(levels, ["fit", "alpha"]).join(fits, ["fit", "alpha"], "left")


def embedding_scores(fits):
    return ridge.cv_summary(fits, ["alpha"])


def score_embeddings(df, fit, column="embedding"):
    """Add `prediction` from one row of fits (intercept, weights)."""
    weights = F.lit(np.array(fit["weights"], float))       # one literal, however long
    products = F.zip_with(F.col(column), weights, lambda x, w: x.cast("double") * w)
    return df.withColumn("prediction", F.aggregate(
        products, F.lit(float(fit["intercept"])), lambda total, p: total + p))


def holdout(df, key, share=settings.HOLDOUT_SHARE, seed=settings.HOLDOUT_SEED):
    """Add `test`: a fixed share of keys by hash, the same on every run and partitioning."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return df.withColumn("test", number < F.lit(int(share * 2 ** 32)))
