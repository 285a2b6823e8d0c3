"""Ridge regression of any size: one distributed Golub-Kahan basis per search.

The matrix is given as long rows (i, t, weight), scaled by row and restricted by term for each group (a
group is one config of a search). Every pair of a group and a fit (a fold held out, or none) is a column, and one
step multiplies all columns at once. A column's basis starts with its centred targets and serves all penalties:
with M = U B V', ridge on the small bidiagonal B gives every alpha's coefficients z of the basis, and a short
recurrence tells the residual, so steps end when each alpha of each column is solved. The centring is a
correction of rank one, by the means of the terms.

Both sides are cut into chunks of rows and of terms, whose vectors are one binary row each; entries are packed
into blocks of bounded size. A step is a join of blocks with the chunks of one side, a product inside a task, and
sums over the chunks of the other side, read as a stream: no task holds more than some blocks and chunks. The
vectors of each step are written down, so a lost executor costs one step; predictions and coefficients
are weighted sums of what was written. The driver holds a few numbers per column and step.
"""

from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textscore.operators.ridge import FULL
from textscore.sources.work import materialise

CELLS = 1 << 20          # numbers of a chunk's vectors
ENTRIES = 1 << 20        # entries of a block


def packed(df, keys, columns, limit=None):
    """Rows of equal `keys` as one row of binary columns, ordered by the first one, at most `limit` rows each."""
    def run(batches):
        key, parts, size = None, [], 0

        def made():
            out = {k: pa.array([v], pa.int64()) for k, v in zip(keys, key)}
            for k, c in enumerate(columns):
                out[c] = pa.array([np.concatenate([p[k] for p in parts]).tobytes()], pa.binary())
            return pa.RecordBatch.from_pydict(out)

        def values(column):
            column = column.flatten() if pa.types.is_list(column.type) else column
            return np.asarray(column)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([np.asarray(batch.column(k)) for k in keys], 1)
            edges = np.flatnonzero((table[1:] != table[:-1]).any(1)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(table)]):
                if parts and (tuple(table[lo]) != key or limit and size >= limit):
                    yield made()
                    parts, size = [], 0
                key = tuple(table[lo])
                parts.append([values(batch.slice(lo, hi - lo).column(c)) for c in columns])
                size += hi - lo
        if parts:
            yield made()

    schema = ", ".join([f"{k} long" for k in keys] + [f"{c} binary" for c in columns])
    rows = df.select(*[F.col(k).cast("long").alias(k) for k in keys], *columns)
    return rows.repartition(*keys).sortWithinPartitions(*keys, columns[0]).mapInArrow(run, schema)


def _read(batches, names):
    """The rows of a stream, one by one."""
    for batch in batches:
        columns = [batch.column(n) for n in names]
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in columns)


def _numbers(data, width=None, kind=np.float64):
    found = np.frombuffer(data, kind)
    return found if width is None else found.reshape(-1, width)


def _inverse(x):
    return np.divide(1.0, x, out=np.zeros_like(x), where=x > 0)


@dataclass
class Sizes:
    """The numbers of a problem, which travel with the tasks."""

    groups: int
    folds: int
    height: int          # rows of a chunk
    width: int           # terms of a chunk
    counts: np.ndarray   # training rows per fit
    means: np.ndarray    # mean target per fit

    @property
    def columns(self):
        return self.groups * (self.folds + 1)

    def training(self, fold):
        """Which rows each column trains on: the last fit of a group on all."""
        per_fit = np.stack([fold != f for f in range(self.folds)] + [np.ones(len(fold), bool)], 1)
        return np.tile(per_fit, (1, self.groups)).astype(float)

    def spread(self, per_group):
        """[rows, groups] as [rows, columns]."""
        return np.repeat(per_group, self.folds + 1, axis=1)


@dataclass
class Problem:
    """The packed matrix and the chunks of both sides."""

    blocks: DataFrame    # (rb, tb, i, t, w): entries of a chunk of rows and a chunk of terms
    rows: DataFrame      # (chunk, y, fold, scale)
    terms: DataFrame     # (chunk, member)
    sizes: Sizes


def problem(entries, rows, terms, folds, groups=1):
    """Pack `entries` (i, t, weight), `rows` (i, y, fold, scale array) and `terms` (t, member array).

    i and t count from 0 without gaps; the arrays have one number per group.
    """
    n, p, nonzero = rows.count(), terms.count(), entries.count()
    columns = groups * (folds + 1)
    height = max(min(n, CELLS // columns), 1)
    density = nonzero / max(n * p, 1)
    width = max(min(p, CELLS // columns, int(ENTRIES / max(height * density, 1e-9))), 1)
    blocks = packed(
        entries.select(F.floor(F.col("i") / height).alias("rb"), F.floor(F.col("t") / width).alias("tb"),
                       (F.col("i") % height).cast("int").alias("i"), (F.col("t") % width).cast("int").alias("t"),
                       F.col("weight").cast("double").alias("w")), ["rb", "tb"], ["i", "t", "w"], ENTRIES)
    # The first packed column orders the rows of a chunk.
    row_chunks = packed(
        rows.select(F.floor(F.col("i") / height).alias("chunk"), F.col("i").cast("long").alias("i"),
                    F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold"), "scale"),
        ["chunk"], ["i", "y", "fold", "scale"])
    term_chunks = packed(terms.select(F.floor(F.col("t") / width).alias("chunk"), F.col("t").cast("long").alias("t"),
                                      "member"), ["chunk"], ["t", "member"])
    per_fold = {r["fold"]: r for r in rows.groupBy("fold").agg(
        F.count("*").alias("n"), F.sum(F.col("y").cast("double")).alias("y")).collect()}
    of = lambda f, c: per_fold[f][c] if f in per_fold else 0
    counts = np.array([n - of(f, "n") for f in range(folds)] + [n], float)
    total = sum(r["y"] for r in per_fold.values())
    sums = np.array([total - of(f, "y") for f in range(folds)] + [total], float)
    return Problem(materialise(blocks, "blocks"), materialise(row_chunks.drop("i"), "row-chunks"),
                   materialise(term_chunks.drop("t"), "term-chunks"),
                   Sizes(groups, folds, height, width, counts, sums / np.maximum(counts, 1)))


def _product(blocks, vectors, to, size, columns, factor):
    """(chunk, touched, values): the shares of the blocks in a product, for the rows they touch.

    `to` names the side of the result, `vectors` (chunk, x) are the other side's, times `factor` by column.
    """
    source, at, by = ("tb", "i", "t") if to == "rb" else ("rb", "t", "i")
    joined = blocks.join(vectors.withColumnRenamed("chunk", source), source).select(to, at, by, "w", "x")

    def run(batches):
        for chunk, i, j, w, x in _read(batches, (to, at, by, "w", "x")):
            i, j, w, x = _numbers(i, kind=np.int32), _numbers(j, kind=np.int32), _numbers(w), _numbers(x, columns) * factor
            seen = np.bincount(i, minlength=size) > 0
            touched = np.flatnonzero(seen)
            place = (np.cumsum(seen) - 1)[i]
            out = np.stack([np.bincount(place, w * x[j, c], len(touched)) for c in range(columns)], 1)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk], pa.int64()), "touched": pa.array([touched.astype(np.int32).tobytes()]),
                "values": pa.array([out.tobytes()])})

    return joined.mapInArrow(run, "chunk long, touched binary, values binary")


def _summed(parts, shares, columns, finish, schema):
    """Per chunk `finish(chunk, parts, sum of the shares)`, as a stream over sorted rows.

    `parts` are tables (chunk, a, b, c) of one row per chunk, which come before the chunk's shares.
    """
    heads = len(parts)
    empty = lambda: F.lit(None).cast("binary")
    every = shares.select("chunk", F.lit(len(parts)).alias("part"), F.col("touched").alias("a"),
                          F.col("values").alias("b"), empty().alias("c"))
    for k, part in enumerate(parts):
        every = every.unionByName(part.select("chunk", F.lit(k).alias("part"), *[
            (F.col(c) if c in part.columns else empty()).alias(c) for c in "abc"]))

    def run(batches):
        for chunk, rows in groupby(_read(batches, ("chunk", "part", "a", "b", "c")), lambda r: r[0]):
            found, total = {}, None
            for _, part, a, b, c in rows:
                if part < heads:
                    found[part] = (a, b, c)
                    continue
                if total is None:
                    total = {}
                touched, values = _numbers(a, kind=np.int32), _numbers(b, columns)
                total.setdefault("sum", np.zeros((size_of(found), columns)))[touched] += values
            sums = total["sum"] if total else np.zeros((size_of(found), columns))
            yield pa.RecordBatch.from_pydict(
                {"chunk": pa.array([chunk], pa.int64()),
                 **{k: pa.array([v.tobytes()], pa.binary()) for k, v in finish([found[k] for k in sorted(found)], sums).items()}})

    def size_of(found):
        return len(found[0][0]) // 8                    # the first part starts with a column of doubles per row

    return (every.repartition("chunk").sortWithinPartitions("chunk", "part")
            .mapInArrow(run, f"chunk long, {schema}"))


def _totals(table, width):
    """The sum of the `sums` of all chunks: a few numbers per chunk."""
    parts = table.select("sums").toArrow().column(0).to_pylist()
    return sum((np.frombuffer(p) for p in parts), np.zeros(width))


@dataclass
class Solution:
    """The steps of a search: what was written, and per alpha the weights of the basis."""

    problem: Problem
    alphas: list
    seen: list = field(default_factory=list)         # per step (chunk, s): products with the basis vector, all rows
    basis: list = field(default_factory=list)        # per step (chunk, v, ...), not normalised
    norms: list = field(default_factory=list)
    shifts: list = field(default_factory=list)       # mean products of the training rows
    z: np.ndarray = None                             # [steps, columns, alphas]
    solved: np.ndarray = None                        # [columns, alphas]

    def intercepts(self):
        """[columns, alphas]"""
        level = np.tile(self.problem.sizes.means, self.problem.sizes.groups)
        return level[:, None] - sum((s[:, None] * z for s, z in zip(self.shifts, self.z)), np.zeros_like(self.solved, float))

    def column(self, group, fit=FULL):
        folds = self.problem.sizes.folds
        return group * (folds + 1) + (folds if fit == FULL else fit)

    def unsolved(self):
        """(group, alpha) of the searches in which a fit is not solved."""
        lost = np.argwhere(~self.solved)
        return sorted({(int(c) // (self.problem.sizes.folds + 1), self.alphas[a]) for c, a in lost})

    def _over_steps(self, first, tables, run, schema):
        every = first
        for k, table in enumerate(tables):
            every = every.unionByName(table.withColumn("step", F.lit(k)), allowMissingColumns=True)
        return (every.repartition("chunk").sortWithinPartitions("chunk", "step").mapInArrow(run, schema))

    def errors(self):
        """(group, alpha, fit, n, sse, sst): a fold's errors on its own rows, and `FULL` on all."""
        own, z, level = self.problem.sizes, self.z, self.intercepts()
        centre, alphas, folds = float(own.means[-1]), list(self.alphas), own.folds

        def run(batches):
            for _, rows in groupby(_read(batches, ("chunk", "step", "y", "fold", "s")), lambda r: r[0]):
                for _, step, targets, held, s in rows:
                    if step < 0:                        # the first row of a chunk
                        y, fold = _numbers(targets), _numbers(held, kind=np.int32)
                        total = [np.tile(level[:, a], (len(y), 1)) for a in range(len(alphas))]
                    else:
                        for a, t in enumerate(total):
                            t += _numbers(s, own.columns) * z[step, :, a]
                out = []
                for a, alpha in enumerate(alphas):
                    miss = (y[:, None] - total[a]) ** 2
                    for c in range(own.columns):
                        fit = c % (folds + 1)
                        at = fold == fit if fit < folds else np.ones(len(y), bool)
                        off = y[at] - centre
                        out.append((c // (folds + 1), alpha, fit if fit < folds else FULL, int(at.sum()),
                                    float(miss[at, c].sum()), float(off.sum()), float((off ** 2).sum())))
                names = ("group", "alpha", "fit", "n", "sse", "off", "square")
                kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int64(), *[pa.float64()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

        first = self.problem.rows.select("chunk", F.lit(-1).alias("step"), "y", "fold")
        parts = self._over_steps(first.withColumn("s", F.lit(None).cast("binary")), [t.select("chunk", "s") for t in self.seen], run,
                                 "group int, alpha double, fit int, n long, sse double, off double, square double")
        return parts.groupBy("group", "alpha", "fit").agg(
            F.sum("n").alias("n"), F.sum("sse").alias("sse"),
            F.greatest(F.sum("square") - F.sum("off") * F.sum("off") / F.sum("n"), F.lit(0.0)).alias("sst")).where("n > 0")

    def coefficients(self, group, alpha, fit=FULL):
        """(t, coefficient) of one fit, distributed."""
        own, c, a = self.problem.sizes, self.column(group, fit), list(self.alphas).index(alpha)
        weights = [float(z[c, a] * _inverse(norm)[c]) for z, norm in zip(self.z, self.norms)]
        width, columns = own.width, own.columns

        def run(batches):
            for chunk, rows in groupby(_read(batches, ("chunk", "step", "v")), lambda r: r[0]):
                total = np.zeros(len(next(rows)[2]) // (8 * own.groups))      # the chunk's members come first
                for _, step, v in rows:
                    total += _numbers(v, columns)[:, c] * weights[step]
                yield pa.RecordBatch.from_pydict({
                    "t": pa.array(chunk * width + np.arange(len(total))), "coefficient": pa.array(total)})

        first = self.problem.terms.select("chunk", F.lit(-1).alias("step"), F.col("member").alias("v"))
        return self._over_steps(first, [t.select("chunk", "v") for t in self.basis], run, "t long, coefficient double")

    def intercept(self, group, alpha, fit=FULL):
        return float(self.intercepts()[self.column(group, fit), list(self.alphas).index(alpha)])


def solve(given, alphas, tolerance=1e-9, max_steps=1000):
    """The basis of a problem, extended until every alpha of every column is solved or the steps are used up.

    Solved: the residual bounds the predictions' error by `tolerance` of the targets' deviation. Columns
    that are done stop growing; a column without training rows or deviation is done at once.
    """
    own = given.sizes
    columns, alphas = own.columns, [float(a) for a in alphas]
    if min(alphas, default=1.0) <= 0:
        raise ValueError("penalties must be positive")
    penalty = np.array(alphas)
    found = Solution(given, alphas)
    means = np.tile(own.means, own.groups)
    weight = _inverse(np.tile(own.counts, own.groups))

    def start(batches):
        for chunk, y, fold, scale in _read(batches, ("chunk", "y", "fold", "scale")):
            mask = own.training(_numbers(fold, kind=np.int32))
            scale, u = own.spread(_numbers(scale, own.groups)), mask * (_numbers(y)[:, None] - means)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([chunk], pa.int64()), "u": pa.array([u.tobytes()]),
                "x": pa.array([(scale * u).tobytes()]), "trained": pa.array([(scale * mask).tobytes()]),
                "sums": pa.array([np.concatenate([(u * u).sum(0), u.sum(0)]).tobytes()])})

    first = materialise(given.rows.mapInArrow(start, "chunk long, u binary, x binary, trained binary, sums binary"), "krylov-start")

    def on_terms(vectors, factor, finish, schema, *before):
        shares = _product(given.blocks, vectors, "tb", own.width, columns, factor)
        # The members come first; one double per term and group, so the rows are counted on their own.
        return _summed([given.terms.withColumnRenamed("member", "b").withColumn("a", F.expr(
            f"unhex(repeat('00', length(b) div {own.groups}))")), *before], shares, columns, finish, schema)

    def centre(parts, total):
        return {"m": own.spread(_numbers(parts[0][1], own.groups)) * total}

    mean_terms = materialise(on_terms(first.select("chunk", F.col("trained").alias("x")), weight, centre, "m binary"), "krylov-means")

    def term_step(table, factor, beta, before, off):
        """A' u - beta v, with the sums of its squares and of its products with the means."""
        def finish(parts, total):
            m = _numbers(parts[1][0], columns)
            v = own.spread(_numbers(parts[0][1], own.groups)) * total - m * off
            if len(parts) > 2:
                v = v - _numbers(parts[2][0], columns) * beta
            return {"v": v, "sums": np.concatenate([(v * v).sum(0), (m * v).sum(0)])}
        others = [mean_terms.select("chunk", F.col("m").alias("a"))]
        if before is not None:
            others.append(before.select("chunk", F.col("v").alias("a")))
        table = materialise(on_terms(table.select("chunk", "x"), factor, finish, "v binary, sums binary", *others), "krylov-terms")
        sums = _totals(table, 2 * columns)
        return table, np.sqrt(np.maximum(sums[:columns], 0)), sums[columns:]

    def row_step(table, factor, shift, before, back):
        """A v - alpha u on the training rows, and the products of all rows."""
        def finish(parts, total):
            _, fold, scale = parts[0]
            scale = own.spread(_numbers(scale, own.groups))
            s = scale * total
            u = own.training(_numbers(fold, kind=np.int32)) * (s - shift) - _numbers(parts[1][0], columns) * back
            return {"s": s, "u": u, "x": scale * u, "sums": np.concatenate([(u * u).sum(0), u.sum(0)])}

        shares = _product(given.blocks, table.select("chunk", F.col("v").alias("x")), "rb", own.height, columns, factor)
        parts = [given.rows.select("chunk", F.col("y").alias("a"), F.col("fold").alias("b"), F.col("scale").alias("c")),
                 before.select("chunk", F.col("u").alias("a"))]
        made = materialise(_summed(parts, shares, columns, finish, "s binary, u binary, x binary, sums binary"), "krylov-rows")
        sums = _totals(made, 2 * columns)
        return made, np.sqrt(np.maximum(sums[:columns], 0)), sums[columns:]

    sums = _totals(first, 2 * columns)
    size = np.sqrt(sums[:columns])
    rows, beta, off = first, size, sums[columns:]
    terms, alpha, shift = term_step(rows, _inverse(beta), None, None, off * _inverse(beta))
    limit = tolerance * np.sqrt(penalty) * size[:, None]
    # The tridiagonal system (B'B + penalty) z = alpha beta e1, factored as it grows.
    below = g = None
    factors = []
    top, found.solved = alpha * size, np.zeros((columns, len(alphas)), bool)
    carried = np.zeros((columns, len(alphas)))
    while True:
        done = found.solved.all(1) | (alpha <= 1e-14 * np.maximum(top, 1e-300))
        alpha = np.where(done, 0.0, alpha)
        found.solved |= (alpha == 0)[:, None]
        if not alpha.any() or len(found.basis) >= max_steps:
            break
        inverse = _inverse(alpha)
        found.basis.append(terms)
        found.norms.append(alpha)
        found.shifts.append(shift * inverse)
        previous = beta
        rows, beta, off = row_step(terms, inverse, shift * inverse, rows, alpha * _inverse(previous))
        beta = np.where(alpha > 0, beta, 0.0)
        found.seen.append(rows)
        diagonal = (alpha ** 2 + beta ** 2)[:, None] + penalty - carried
        g = (alpha * size)[:, None] * np.ones(len(alphas)) if below is None else -below * g
        last, last_norm = terms, alpha
        terms, alpha, shift = term_step(
            rows, _inverse(beta), beta * _inverse(last_norm), last, off * _inverse(beta))
        alpha = np.where(beta > 0, alpha, 0.0)
        corner = (alpha * beta)[:, None]
        below, carried = corner / diagonal, corner ** 2 / diagonal
        factors.append((g, diagonal, below))
        found.solved |= np.abs(corner * g / diagonal) <= limit
    z = np.zeros((len(factors), columns, len(alphas)))
    after = np.zeros((columns, len(alphas)))
    for k in range(len(factors) - 1, -1, -1):
        g, diagonal, below = factors[k]
        after = z[k] = g / diagonal - below * after
    found.z = z
    return found
