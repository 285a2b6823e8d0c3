"""Gram matrices of rows, any number of terms, and ridge from one that fits a task.

The rows' Gram matrix is a sum over terms. Terms are dealt into blocks, a block's share is one
small matrix product in a task, and the shares add up map-side: no pair of rows is ever
emitted per term. `tiles` does the same for any number of rows, in square tiles.
"""

import time
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from textscore.operators import krylov
from textscore.operators.ridge import FULL, sum_arrays
from textscore.sources.work import materialise

# Rows per block of terms: as many as its matrix has numbers, within these limits.
BLOCK_ROWS = (50_000, 2_000_000)
CHUNK = 1024


def block_count(nonzeros, n):
    least, most = BLOCK_ROWS
    return max(-(-nonzeros // min(max(n * n, least), most)), 1)


def partial_grams(weights, n, cell, blocks=1):
    """(cell columns, i, values): Gram rows of each cell's terms, to be summed.

    `weights` holds one row (cell, ngram, term, i, weight) per row i < n and term.
    """
    cell = list(cell)
    keyed = weights.select(
        *cell, "i", "weight", F.concat_ws(":", "ngram", "term").alias("column"),
        F.pmod(F.xxhash64("ngram", "term"), F.lit(blocks)).alias("block"))

    def share(keys, pdf):
        columns, _ = pd.factorize(pdf["column"])
        i, w = pdf["i"].to_numpy(), pdf["weight"].to_numpy()
        present, at = np.unique(i, return_inverse=True)
        by_column = np.argsort(columns, kind="stable")
        edges = np.searchsorted(columns[by_column], np.arange(0, columns.max() + CHUNK + 1, CHUNK))
        gram = np.zeros((len(present), len(present)))
        for lo, hi in zip(edges[:-1], edges[1:]):
            rows = by_column[lo:hi]
            if len(rows):
                m = np.zeros((len(present), CHUNK))
                m[at[rows], columns[rows] % CHUNK] = w[rows]
                gram += m @ m.T
        values = np.zeros((len(present), n))
        values[:, present] = gram
        out = pd.DataFrame({"i": present.astype("int32"), "values": list(values)})
        for name, value in zip(cell, keys):
            out[name] = value
        return out

    schema = ", ".join(f"{c} int" for c in cell) + ", i int, values array<double>"
    return keyed.groupBy(*cell, "block").applyInPandas(share, schema)


def tiles(entries, n, terms, side=1024):
    """(a, b, values): the products of all rows i < n as square tiles, a <= b, `values` row by row.

    `entries` is (i, t, weight) with t < `terms`. Blocks of rows and terms meet in pairs, a pair's product is
    one tile at most, and tiles are added up as a stream: nothing grows with the number of rows but the tiles' number.
    """
    side = max(min(side, n), 1)
    density = entries.count() / max(n * terms, 1)
    width = max(min(terms, krylov.CELLS // side, int(krylov.ENTRIES / max(side * density, 1e-9))), 1)
    blocks = materialise(krylov.packed(
        entries.select(F.floor(F.col("i") / side).alias("rb"), F.floor(F.col("t") / width).alias("tb"),
                       (F.col("i") % side).cast("int").alias("i"), (F.col("t") % width).cast("int").alias("t"),
                       F.col("weight").cast("double").alias("w")),
        ["rb", "tb"], ["i", "t", "w"], krylov.ENTRIES), "gram-blocks")
    at = lambda s: blocks.select("tb", *[F.col(c).alias(s + c) for c in ("rb", "i", "t", "w")])
    pairs = at("x").join(at("y"), "tb").where("xrb <= yrb")

    def dense(i, t, w):
        rows = np.frombuffer(i, np.int32)
        out = np.zeros((rows.max() + 1, width))
        out[rows, np.frombuffer(t, np.int32)] = np.frombuffer(w)
        return out

    def product(batches):
        for a, b, *halves in krylov._read(batches, ("xrb", "yrb", "xi", "xt", "xw", "yi", "yt", "yw")):
            x, y = dense(*halves[:3]), dense(*halves[3:])
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([a]), "b": pa.array([b]), "width": pa.array([len(y)], pa.int32()),
                "values": pa.array([(x @ y.T).tobytes()])})

    def add(batches):
        for (a, b), rows in groupby(krylov._read(batches, ("a", "b", "width", "values")), lambda r: r[:2]):
            total = np.zeros((min(side, n - a * side), min(side, n - b * side)))
            for _, _, columns, values in rows:
                part = np.frombuffer(values).reshape(-1, columns)
                total[:len(part), :columns] += part
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([a]), "b": pa.array([b]), "values": pa.array([total.tobytes()])})

    shares = pairs.mapInArrow(product, "a long, b long, width int, values binary")
    return (shares.repartition("a", "b").sortWithinPartitions("a", "b")
            .mapInArrow(add, "a long, b long, values binary"))


def tile_products(tiled, n, side=1024):
    """(i, j, product) of the pairs i <= j whose product is not 0."""
    side = max(min(side, n), 1)

    def run(batches):
        for a, b, values in krylov._read(batches, ("a", "b", "values")):
            tile = np.frombuffer(values).reshape(-1, min(side, n - b * side))
            tile = np.triu(tile) if a == b else tile
            i, j = np.nonzero(tile)
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(i + a * side), "j": pa.array(j + b * side), "product": pa.array(tile[i, j])})

    return tiled.mapInArrow(run, "i long, j long, product double")


def gram_rows(partials, keys):
    return sum_arrays(partials, [*keys, "i"])


def cosine(gram):
    """Gram matrix of the rows scaled to length 1; zero rows stay zero."""
    length = np.sqrt(np.diag(gram))
    inverse = np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)
    return gram * inverse[:, None] * inverse[None, :], inverse


def dual_path(kernel, y, train, alphas):
    """Per alpha the dual coefficients of the training rows, intercept and all predictions."""
    k = kernel[np.ix_(train, train)]
    mean = k.mean(axis=0)
    centred = k - mean[None, :] - mean[:, None] + mean.mean()
    lam, u = np.linalg.eigh(centred)
    level = y[train].mean()
    projected = u.T @ (y[train] - level)
    for alpha in alphas:
        a = u @ (projected / (np.maximum(lam, 0.0) + alpha))
        a -= a.mean()
        intercept = level - mean @ a
        yield alpha, a, intercept, kernel[:, train] @ a + intercept


def _matrix(pdf, n):
    gram = np.zeros((n, n))
    for i, row in zip(pdf["i"], pdf["values"]):
        if len(row):
            gram[i] = row
    return gram


def grid_predictions(grams, y, folds, k, alphas):
    """(config, alpha, fit, i, y, prediction, seconds, error) for every config in `grams`.

    One task per config does all its folds and alphas; `y` and `folds` are the n targets and
    fold numbers in row order. A fit that fails is one row per alpha, with its error and no prediction.
    """
    y, folds, alphas = np.asarray(y, float), np.asarray(folds), [float(a) for a in alphas]
    rows = np.arange(len(y))

    def scores(kernel, fit):
        train = rows if fit == FULL else rows[folds != fit]
        test = rows if fit == FULL else rows[folds == fit]
        return [pd.DataFrame({"alpha": alpha, "i": test, "y": y[test], "prediction": prediction[test], "error": None})
                for alpha, _, _, prediction in dual_path(kernel, y, train, alphas)]

    def solve(pdf):
        kernel, _ = cosine(_matrix(pdf, len(y)))
        out = []
        for fit in [*range(k), FULL]:
            started = time.perf_counter()
            try:
                frames = scores(kernel, fit)
            except Exception as error:  # one fit's failure is a row, not the end of the grid
                text = f"{type(error).__name__}: {error}"[:500]
                frames = [pd.DataFrame({"alpha": [a], "i": [0], "y": [None], "prediction": [None], "error": [text]})
                          for a in alphas]
            spent = (time.perf_counter() - started) / len(alphas)
            for frame in frames:
                frame["fit"], frame["seconds"] = fit, spent / max(len(frame), 1)
            out += frames
        config = int(pdf["config"].iloc[0])
        whole = pd.concat([f.astype({"y": float, "prediction": float, "error": object}) for f in out])
        return whole.assign(config=config)[["config", "alpha", "fit", "i", "y", "prediction", "seconds", "error"]]

    return grams.groupBy("config").applyInPandas(
        solve, "config int, alpha double, fit int, i int, y double, prediction double, "
               "seconds double, error string")


def dual_coefficients(grams, y, alpha):
    """(i, coefficient, intercept): weights of the unscaled rows, fitted on all of them."""
    y = np.asarray(y, float)

    def solve(pdf):
        kernel, inverse = cosine(_matrix(pdf, len(y)))
        _, a, intercept, _ = next(dual_path(kernel, y, np.arange(len(y)), [float(alpha)]))
        return pd.DataFrame({"i": np.arange(len(y)), "coefficient": a * inverse,
                             "intercept": intercept})

    return grams.groupBy("config").applyInPandas(
        solve, "i int, coefficient double, intercept double")
