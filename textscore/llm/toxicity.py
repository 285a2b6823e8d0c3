"""Toxicity: cumulative-link ordinal regression on sparse word and word-start features.

P(grade <= k) = sigmoid(cut_k - w.x): one weight per feature, shared by all thresholds, and ordered
cuts. The score is the expected grade, sum over k of P(grade > k). Words are matched with A-Z
lower-cased and outer ASCII punctuation cut. A feature is a word, or the first 3 to 7 characters of one
(inflected stems); its value is log(1 + occurrences).

Features and weights are fitted on a bounded sample of labelled rows: the `sample` smallest hashes
of the id. The features are those that separate marked rows best. Every row is scored, whole.

Defined results: a null or empty text has no feature and gets the base rate, so it is not rejected
unless the base rate is. Null labels are left out. With no labelled rows, one grade only, or no
feature in `min_rows` rows that separates the sides (|z| over 4), as in tables of some dozen marked rows, there
is no model: expected grade 0 and nothing is rejected. Repeated rows are scored one by one; labels
repeated for an id count once each. Extra columns stay; one named like a new column is replaced.
"""

import math

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textscore.llm.text import slices, without
from textscore.sources.work import materialise

STARTS = range(3, 8)
_OUTER = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def words_of(text):
    """Lower-cased words (A-Z only) without outer ASCII punctuation."""
    return [w for w in (x.strip(_OUTER) for x in text.lower().split()) if w]


def features_of(word):
    """The word, and its starts of 3 to 7 characters (marked by a final blank)."""
    cuts = [i for i in range(1, len(word) + 1) if i == len(word) or word[i] & 0xC0 != 0x80]
    return [word, *(word[:cuts[n - 1]] + b" " for n in STARTS if n <= len(cuts))]


def _row_frequencies(labelled, text):
    """(feature, n1, n0): the rows of each side with the feature, summed per task, then shuffled."""
    def emit(counts):
        return pa.RecordBatch.from_pydict({
            "feature": pa.array(list(counts), pa.binary()),
            "n1": pa.array([v[1] for v in counts.values()], pa.int64()),
            "n0": pa.array([v[0] for v in counts.values()], pa.int64())})

    def run(batches):
        counts = {}
        for batch in batches:
            for rows, texts in slices(batch, text):
                for side, value in zip(rows.column("_side").to_pylist(), texts):
                    for f in {f for w in set(words_of(value)) for f in features_of(w)}:
                        counts.setdefault(f, [0, 0])[side] += 1
                if len(counts) > 500_000:
                    yield emit(counts)
                    counts = {}
        yield emit(counts)

    return (labelled.select(text, "_side").mapInArrow(run, "feature binary, n1 long, n0 long")
            .groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")))


def choose_features(labelled, text, size=512, min_rows=10):
    """The `size` features that separate the sides best (z of the smoothed log odds); a top-k."""
    rows = {r["_side"]: r["count"] for r in labelled.groupBy("_side").count().collect()}
    n1, n0 = rows.get(1, 0), rows.get(0, 0)
    if not n1 or not n0:
        return []
    log_odds = (F.log((F.col("n1") + 0.5) / (F.lit(n1) - F.col("n1") + 0.5))
                - F.log((F.col("n0") + 0.5) / (F.lit(n0) - F.col("n0") + 0.5)))
    spread = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    found = (_row_frequencies(labelled, text).filter(F.col("n1") + F.col("n0") >= min_rows)
             .withColumn("z", log_odds / spread).filter(F.abs("z") > 4)
             .orderBy(F.desc(F.abs(F.col("z"))), "feature").limit(size).collect())
    return [(bytes(r["feature"]), r["z"]) for r in found]


def fit_ordinal(x, grades, levels, l2=1e-4, steps=600, rate=0.5):
    """Weights and ordered cuts by accelerated gradient descent on the mean log loss."""
    rows, width = x.shape
    w = np.zeros(width)
    share = np.array([(grades <= k).mean() for k in range(levels - 1)]).clip(1e-4, 1 - 1e-4)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-6 * np.arange(levels - 1))
    # Cuts are first + running sums of exponentials, so they stay in order.
    raw = np.concatenate([[cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))])
    theta = np.concatenate([w, raw])
    speed, m2 = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        w, raw = theta[:width], theta[width:]
        gaps = np.exp(raw[1:])
        cuts = raw[0] + np.concatenate([[0], np.cumsum(gaps)])
        z = x @ w
        below = sigmoid(np.concatenate([[-40], cuts, [40]])[None, :] - z[:, None])
        below[:, 0], below[:, -1] = 0, 1
        upper, lower = below[np.arange(rows), grades + 1], below[np.arange(rows), grades]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        dz = (du - dl) / rows                       # d loss / d z
        d_cuts = np.zeros(levels - 1)
        np.add.at(d_cuts, grades[grades < levels - 1], -du[grades < levels - 1] / rows)
        np.add.at(d_cuts, grades[grades > 0] - 1, dl[grades > 0] / rows)
        tail = np.cumsum(d_cuts[::-1])[::-1]        # a gap moves all later cuts
        g = np.concatenate([x.T @ dz + l2 * w, [tail[0]], tail[1:] * gaps])
        speed = 0.9 * speed + 0.1 * g
        m2 = 0.999 * m2 + 0.001 * g * g
        theta = theta - rate / 10 * (speed / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    w, raw = theta[:width], theta[width:]
    return w, raw[0] + np.concatenate([[0], np.cumsum(np.exp(raw[1:]))])


def expected_grade(z, cuts):
    """Sum over the cuts of P(grade > k)."""
    return sum(1 / (1 + np.exp(np.clip(c - z, -40, 40))) for c in cuts)


def _values(texts, index, known):
    """For each text its features as a dict number -> log(1 + occurrences); `known` is a word cache."""
    for value in texts:
        found = {}
        for w in words_of(value):
            hits = known.get(w)
            if hits is None:
                hits = [index[f] for f in features_of(w) if f in index]
                if len(known) < 200_000:
                    known[w] = hits
            for j in hits:
                found[j] = found.get(j, 0) + 1
        yield {j: math.log1p(n) for j, n in found.items()}


def fit(docs, labels, text="text", key="doc_id", label="toxic", grade=None, levels=4,
        sample=10_000, size=512):
    """A model, as a plain dict, from labelled documents.

    `grade` names a column with grades 0..levels-1. Without one the labels carry one bit: rows
    not marked are grade 0, and marked rows get grades 1..levels-1 by how often the words that the
    marked rows over-use occur in them (equal shares of the marked rows of the sample).
    """
    target = grade or label
    left = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    # At most `sample` pairs of numbers: small enough to send to every task.
    right = (labels.select(F.col(key).alias("_key"), F.col(target).alias("_grade"))
             .filter(F.col("_grade").isNotNull())
             .orderBy(F.xxhash64("_key"), "_key", "_grade").limit(sample))
    labelled = materialise(left.join(F.broadcast(right), "_key")
                           .withColumn("_side", (F.col("_grade") > 0).cast("int")), "labelled")
    words = choose_features(labelled, "_text", size)
    if not words:
        return None
    index = {w: j for j, (w, _) in enumerate(words)}

    def run(batches):
        known = {}
        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                values = list(_values(texts, index, known))
                yield pa.RecordBatch.from_pydict({
                    "rank": rows.column("rank"), "grade": rows.column("_grade").cast(pa.int64()),
                    "at": pa.array([list(v) for v in values], pa.list_(pa.int32())),
                    "value": pa.array([list(v.values()) for v in values], pa.list_(pa.float64()))})

    # As many rows as the sample has, each with the few features it holds.
    rows = (labelled.select(F.xxhash64("_key").alias("rank"), "_grade", "_text")
            .mapInArrow(run, "rank long, grade long, at array<int>, value array<double>")
            .orderBy("rank", "grade", "at", "value").collect())
    grades = np.array([r["grade"] for r in rows], int)
    x = np.zeros((len(rows), len(index)))
    for i, r in enumerate(rows):
        x[i, r["at"]] = r["value"]
    if grade is None:
        marked = np.flatnonzero(grades > 0)
        over = np.array([z > 0 for _, z in words])
        strength = np.expm1(x[marked][:, over]).sum(1)
        place = np.argsort(np.argsort(strength, kind="stable"), kind="stable")
        grades[marked] = 1 + place * (levels - 1) // max(len(marked), 1)
    if len(np.unique(grades)) < 2:
        return None
    w, cuts = fit_ordinal(x, grades, levels)
    return {"index": index, "weights": w, "cuts": cuts}


def score(docs, model, text="text"):
    """`docs` with `severity` (expected grade) and `p_any` (probability of a grade above 0)."""
    docs = without(docs, "severity", "p_any")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns
    if model is None:
        return docs.withColumns({"severity": F.lit(0.0), "p_any": F.lit(0.0)})
    index, w, cuts = model["index"], model["weights"], model["cuts"]

    def run(batches):
        known = {}
        for batch in batches:
            for rows, texts in slices(batch, text):
                z = np.array([sum(w[j] * v for j, v in row.items())
                              for row in _values(texts, index, known)], float)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(expected_grade(z, cuts)),
                     pa.array(expected_grade(z, cuts[:1]))], names=[*names, "severity", "p_any"])

    return docs.mapInArrow(run, f"{fields}, severity double, p_any double")


def verdicts(docs, labels, text="text", key="doc_id", reject=0.4, **options):
    """Score all documents; `toxic` where a grade above 0 is at least as likely as `reject`."""
    return (score(docs, fit(docs, labels, text, key, **options), text)
            .withColumn("rejected", F.col("p_any") >= reject))
