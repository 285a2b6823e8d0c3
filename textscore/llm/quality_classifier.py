"""Quality classifier: a sparse rule ensemble compiled to column expressions.

Shallow trees are boosted on statistics of labelled texts. Every path from a root to a node
becomes a conjunctive rule; a lasso logistic regression keeps few of them. The kept rules
are compiled to Spark expressions, so scoring runs on the table of statistics inside the JVM. Texts
are reduced to their statistics in Arrow batches; label, language, source and id are no inputs.

The model is fitted on a bounded sample of labelled rows (`sample`, the smallest hashes of the id, of
those that `learn` allows); every row is scored, whole.

Defined results: null and empty texts have zero statistics and get the score of those. Null labels
are left out. With no labelled rows or one class only the score is the share of label 1 (0.5 with
none). Repeated rows are scored one by one. Extra columns stay; one named like a new column is replaced.
"""

from functools import reduce
from operator import and_

import numpy as np

from pyspark.sql import functions as F

from textscore.llm.quality_rules import count_texts
from textscore.llm.text import Words, over_texts, without
from textscore.sources.work import materialise

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs",
          "n_distinct", "n_digits", "n_stops", "n_lines")
#: Statistic: (numerator, denominator) of counts.
STATISTICS = {"words": ("n_words", None), "word_length": ("word_chars", "n_words"),
              "symbols": ("n_symbols", "word_chars"), "bangs": ("n_bangs", "n_words"),
              "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"),
              "distinct": ("n_distinct", "n_words"), "repeats": ("n_repeat_words", "n_words"),
              "dup_lines": ("n_dup_lines", "n_lines"), "stops": ("n_stops", "n_words"),
              "lines": ("n_lines", "n_words")}


def count_more(texts):
    """The counts behind the statistics, for each text."""
    found = count_texts(texts)
    words = Words(texts)
    # Distinct words per text: the first of each run of equal (text, word).
    order = np.lexsort((words.hash, words.text))
    h, t = words.hash[order], words.text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    per = lambda flag: np.add.reduceat(flag.astype(np.int64), words.offset[:-1])
    data = words.data
    return found | {"n_distinct": np.bincount(t[new], minlength=len(texts)).astype(np.int64),
                    "n_digits": per((data >= 48) & (data <= 57)),
                    "n_stops": per((data == 46) | (data == 63)), "n_lines": per(data == 10)}


def with_statistics(counts):
    share = lambda n, d: (F.col(n).cast("double") if d is None
                          else F.col(n) / F.greatest(F.col(d), F.lit(1)))
    return counts.withColumns({f"stat_{s}": share(*nd) for s, nd in STATISTICS.items()})


def _tree(bins, grad, hess, depth, min_rows, path=(), rows=None):
    """Grow one tree on binned features; yields the path of every node as ((feature, bin, above), ...)."""
    rows = np.arange(len(grad)) if rows is None else rows
    if path:
        yield path, rows
    if depth == 0 or len(rows) < 2 * min_rows:
        return
    g, h = grad[rows], hess[rows]
    whole, best = g.sum() ** 2 / (h.sum() + 1), None
    for j in range(bins.shape[1]):
        b = bins[rows, j]
        gs, hs, ns = (np.cumsum(np.bincount(b, w, 33))[:-1] for w in (g, h, np.ones(len(b))))
        right = len(rows) - ns
        gain = gs ** 2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
        gain[(ns < min_rows) | (right < min_rows)] = -1
        k = int(gain.argmax())
        if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
            best = gain[k], j, k
    if best is None:
        return
    _, j, k = best
    above = bins[rows, j] > k
    yield from _tree(bins, grad, hess, depth - 1, min_rows, (*path, (j, k, False)), rows[~above])
    yield from _tree(bins, grad, hess, depth - 1, min_rows, (*path, (j, k, True)), rows[above])


def grow_rules(x, y, trees=24, depth=3, rate=0.3, min_rows=None):
    """Distinct rules ((statistic number, threshold, above), ...) of boosted trees."""
    min_rows = min_rows or max(5, len(y) // 500)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    z, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        leaves = {}
        for path, rows in _tree(bins, grad, hess, depth, min_rows):
            rule = tuple(sorted((j, float(cuts[j][min(k, len(cuts[j]) - 1)]), above) for j, k, above in path))
            rules.setdefault(rule, None)
            leaves[path] = rows
        for path, rows in leaves.items():
            if not any(len(o) > len(path) and o[:len(path)] == path for o in leaves):
                z[rows] += rate * grad[rows].sum() / (hess[rows].sum() + 1)
    return list(rules)


def holds(rule, x):
    return np.all([(x[:, j] > c) == above for j, c, above in rule], axis=0)


def fit_lasso(r, y, penalty, steps=400):
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal steps."""
    n, width = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    power = np.ones(width + 1)
    for _ in range(30):                              # the largest eigenvalue sets the step
        power = a.T @ (a @ power)
        power /= np.linalg.norm(power)
    step = 4 * n / (power @ (a.T @ (a @ power)))
    w = v = np.zeros(width + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -40, 40)))
        new = v - step * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[0], w[1:]


def fit(stats, labels, key="doc_id", label="quality", learn=None, sample=20_000, penalty=1e-3):
    """(intercept, [(weight, rule)]) from a table with stat_* columns and labels."""
    allowed = labels.select(F.col(key).alias("_key"), F.col(label).alias("_y")).filter(F.col("_y").isNotNull())
    if learn is not None:
        allowed = allowed.filter(learn(F.col("_key")))
    # At most `sample` pairs of numbers: small enough to send to every task.
    chosen = allowed.orderBy(F.xxhash64("_key"), "_key", "_y").limit(sample)
    names = [f"stat_{s}" for s in STATISTICS]
    rows = (stats.select(F.col(key).alias("_key"), *names).join(F.broadcast(chosen), "_key")
            .select("_key", "_y", *names).toArrow().to_pandas().sort_values(["_key", "_y", *names]))
    y = (rows["_y"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-4), 1 - 1e-4)
        return float(np.log(share / (1 - share))), []
    x = rows[names].to_numpy(float)
    rules = grow_rules(x, y)
    if not rules:
        return float(np.log(y.mean() / (1 - y.mean()))), []
    bias, weights = fit_lasso(np.stack([holds(r, x) for r in rules], 1).astype(float), y, penalty)
    return float(bias), [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-9]


def compile_rules(model):
    """The score as one Spark expression over the stat_* columns."""
    bias, rules = model
    names = [f"stat_{s}" for s in STATISTICS]
    z = F.lit(bias)
    for weight, rule in rules:
        test = reduce(and_, [F.col(names[j]) > F.lit(c) if above else F.col(names[j]) <= F.lit(c)
                             for j, c, above in rule])
        z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def classify(docs, labels, text="text", key="doc_id", learn=None, cut=0.7, **options):
    """`docs` without the text, with `score` and `predicted`."""
    docs = without(docs, "score", "predicted", *COUNTS, *[f"stat_{s}" for s in STATISTICS])
    kept = [c for c in docs.columns if c != text]
    counts = over_texts(docs, text, ", ".join(f"{c} long" for c in COUNTS), count_more, kept)
    stats = with_statistics(materialise(counts, "statistics"))
    model = fit(stats, labels, key, learn=learn, **options)
    score = F.round(compile_rules(model), 12)
    return (stats.withColumn("score", score)
            .withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
            .select(*kept, "score", "predicted"))
