"""LM scoring with Brown class-based bigrams.

P(w | history) = P(class(w) | class of the history) x P(w | class(w)).

Words are counted over all learning texts. The `dictionary` most frequent words have classes: the
exchange algorithm clusters the `seeds` most frequent ones on the counts of their pairs (other words between two
seeds are passed over, so rare words cannot hide them), one word at a time and from several starts, and batched
sweeps carry it on over the dictionary: every word moves to the class whose neighbours on both sides are most like
its own, while the likelihood grows (sums of whole numbers, so the result does not depend on order). A word that
has no seed beside it takes the class with most tokens until its neighbours have classes. The remaining words are one class of their own, `tail`, whose words are looked up by a
join with the counts, as a vocabulary has no bound; `end` is a class of one token. The
history is the class of the nearest earlier dictionary word, or the start. Transitions are
interpolated with class frequencies, emissions are smoothed by `delta`, and the tail keeps one share for
unseen words, so the probabilities sum to one.

Three passes over the texts run in Arrow batches with whole-task sums before each shuffle: word
counts, numbers of the tokens, scores. The numbers are written down; seed bigrams, the
sweeps' counts and transitions are taken from them, the transitions for every token with the history that scores use. The driver
holds the dictionary and tables of seeds and classes, whose sizes are parameters; all counts cover all learning texts.

Tokens: A-Z lower-cased, words as runs of bytes other than space and 0x09-0x0D, then one end token.

Defined results: null and empty texts are an end token alone. With no learning text every count
is 0 and the model gives 0.5 to `end` and to `tail`. Rows equal in id and text get one result each, the same.
Extra columns stay out.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textscore.llm.text import in_small_batches, slices
from textscore.sources.work import materialise

FLUSH = 400_000
UNIT = 1 << 20                            # log ratios as whole numbers of this fraction
SLICES = 128                              # rows of numbers, of about 1 MB of text each, that a task sums at least
MOST = 1 << 28                            # tokens a task counts before it sends their sums


def words_of(text):
    return text.lower().split()


def count_words(texts):
    """(word, n) of a table of texts; each task sums before it sends."""
    def emit(counts):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()),
                                           "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches):
        counts = Counter()
        for batch in batches:
            for _, own in slices(batch, "_text"):
                for t in own:
                    counts.update(words_of(t))
                if len(counts) > FLUSH:
                    yield emit(counts)
                    counts = Counter()
        yield emit(counts)

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _numbers(lookup, words):
    """Dictionary numbers of words, -1 for others."""
    return np.fromiter((lookup.get(w, -1) for w in words), np.int32, len(words))


def encode(texts, words):
    """(codes): the numbers of all tokens, one row per slice of texts, byte by byte (`decoded`).

    Dictionary words have their numbers, then come the tail and the end token, which closes each text.
    """
    shared = texts.sparkSession.sparkContext.broadcast(b"\n".join(words))

    def run(batches):
        lookup = {w: i for i, w in enumerate(shared.value.split(b"\n"))} if shared.value else {}
        tail, end = len(lookup), np.array([len(lookup) + 1], np.int32)
        for batch in batches:
            for _, own in slices(batch, "_text"):
                parts = [p for t in own for p in (_numbers(lookup, words_of(t)), end)]
                codes = np.concatenate([*parts, end[:0]])
                codes[codes < 0] = tail
                # Equal bytes of the numbers lie together, which compresses well.
                rows = codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
                yield pa.RecordBatch.from_pydict({"codes": pa.array([rows], pa.binary())})

    return texts.mapInArrow(run, "codes binary")


def decoded(batches, size):
    """(codes, histories) of the rows of `encode`: a history is the nearest earlier dictionary word, or the end
    token of the text before, which is the start."""
    for batch in batches:
        for row in batch.column("codes"):
            codes = np.frombuffer(row.as_buffer(), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
            at = np.where(codes != size, np.arange(1, len(codes) + 1), 0)
            last = np.maximum.accumulate(np.concatenate([[0], at[:-1]]))
            yield codes, np.concatenate([[size + 1], codes])[last]


def few_tasks(codes):
    """The numbers read by one task for `SLICES` rows: each task of a sweep sends sums of the whole dictionary, however little
    it read."""
    return codes.coalesce(-(-codes.count() // SLICES) or 1)


def _sums(codes, size, cells, run_on):
    """(cell, n): how often `run_on(codes, histories)` gives each cell number, over all texts."""
    def run(batches):
        total = np.zeros(cells, np.int64)
        for own, history in decoded(batches, size):
            np.add.at(total, run_on(own, history), 1)
        cell = np.flatnonzero(total)
        for k in range(0, len(cell), 1 << 16):
            part = cell[k:k + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(part), "n": pa.array(total[part])})

    return codes.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def _table(sums, rows, columns):
    """The sums of few cells as a dense matrix."""
    found = sums.toArrow()
    table = np.zeros(rows * columns)
    table[np.asarray(found["cell"])] = np.asarray(found["n"])
    return table.reshape(rows, columns)


def seed_bigrams(codes, size, k):
    """Dense matrix of the pairs of a seed word and the nearest earlier seed word of its text, whatever lies between."""
    def run_on(own, _):
        # A text's end token closes it, so no pair reaches over it.
        marks = own[(own < k) | (own == size + 1)].astype(np.int64)
        left, right = marks[:-1], marks[1:]
        both = (left < k) & (right < k)
        return left[both] * k + right[both]

    return _table(_sums(codes, size, k * k, run_on), k, k)


def starts(bigrams, classes, most=4):
    """Assignments to start from: in turn by frequency, and equal runs along the main directions of who stands beside whom."""
    k = len(bigrams)
    found = [np.arange(k) % classes]
    both = bigrams + bigrams.T
    degree = np.sqrt(np.maximum(both.sum(1), 1e-12))
    value, vector = np.linalg.eigh(both / degree[:, None] / degree[None, :])
    for at in np.argsort(-np.abs(value), kind="stable")[:most]:
        place = np.empty(k, np.int64)
        place[np.argsort(np.round(vector[:, at] / degree, 9), kind="stable")] = np.arange(k)
        found.append(place * classes // k)
    return found


def exchange(bigrams, classes):
    """Class of each seed word: the best result of the exchange from several starts."""
    if classes < 2:
        return np.zeros(len(bigrams), np.int64)
    found = [_exchange(bigrams, classes, own) for own in starts(bigrams, classes)]
    cells = lambda own: np.eye(classes)[own].T @ bigrams @ np.eye(classes)[own]
    return max(found, key=lambda own: likelihood(cells(own)))


def _exchange(bigrams, classes, own, sweeps=12):
    """Single words move while the class bigram likelihood grows; a class keeps its last word."""
    k, own = len(bigrams), own.copy()
    member = np.eye(classes)[own]                    # [word, class]
    m = member.T @ bigrams @ member
    gain = lambda v: v * np.log(np.maximum(v, 1e-12))
    for _ in range(sweeps):
        moved = 0
        for w in range(k):
            right, left, same = bigrams[w] @ member, bigrams[:, w] @ member, bigrams[w, w]
            old = own[w]
            if (own == old).sum() == 1:
                continue
            right[old] -= same
            left[old] -= same
            m[old] -= right
            m[:, old] -= left
            m[old, old] -= same
            rows, cols = m.sum(1), m.sum(0)
            diagonal = np.arange(classes)
            out = gain(m + right) - gain(m)
            into = gain(m.T + left) - gain(m.T)
            change = out.sum(1) + into.sum(1) - out[diagonal, diagonal] - into[diagonal, diagonal]
            d = m[diagonal, diagonal]
            change += gain(d + right + left + same) - gain(d)
            change -= gain(rows + right.sum() + same) - gain(rows)
            change -= gain(cols + left.sum() + same) - gain(cols)
            new = int(change.argmax()) if change.max() > change[old] + 1e-9 else old
            m[new] += right
            m[:, new] += left
            m[new, new] += same
            if new != old:
                member[w, old], member[w, new], own[w] = 0, 1, new
                moved += 1
        if not moved:
            break
    return own


def transitions(codes, own, classes):
    """Counts [history, class] of all tokens: histories are classes, then the start; classes end with tail, end.

    Words with class -1 are left out.
    """
    size = len(own)
    shared = codes.sparkSession.sparkContext.broadcast(own.astype(np.int64))

    def run_on(words, history):
        left = np.concatenate([shared.value, [-1, classes]])[history]
        right = np.concatenate([shared.value, [classes, classes + 1]])[words]
        known = (left >= 0) & (right >= 0)
        return left[known] * (classes + 2) + right[known]

    return _table(_sums(codes, size, (classes + 1) * (classes + 2), run_on), classes + 1, classes + 2)


def likelihood(moves):
    """Log likelihood of the classes' bigrams, up to what does not depend on the classes."""
    gain = lambda v: float((v * np.log(np.maximum(v, 1))).sum())
    return gain(moves) - gain(moves.sum(1)) - gain(moves.sum(0))


def best_classes(codes, own, moves, most=MOST):
    """(word, class): for each dictionary word the class whose neighbours on both sides are most like its own.

    Neighbours count by class, start, tail and end; those with class -1 are left out, as are words that have no others.
    """
    size, classes = len(own), len(moves) - 1
    before = moves[:, :classes].T + 0.1               # [class, class or start before]
    after = moves[:classes] + 0.1                     # [class, class, tail or end after]
    ratio = np.concatenate([np.log(before / before.sum(1, keepdims=True)),
                            np.log(after / after.sum(1, keepdims=True))], 1).T
    wide = len(ratio)
    shared = codes.sparkSession.sparkContext.broadcast((own.astype(np.int64), np.round(ratio * UNIT)))

    def run(batches):
        kind, weight = shared.value
        left, right = np.concatenate([kind, [-1, classes]]), np.concatenate([kind, [classes, classes + 1]])
        total, seen = np.zeros((size, wide), np.int32), 0

        def sums():
            held = np.flatnonzero(total.any(1))
            for k in range(0, len(held), 1 << 14):
                part = held[k:k + (1 << 14)]
                # Whole numbers below 2 ** 53 for so many tokens, so floats are exact.
                scores = (total[part].astype(float) @ weight).astype(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {"word": pa.array(part), **{f"k{k}": pa.array(scores[:, k]) for k in range(classes)}})

        for words, history in decoded(batches, size):
            if seen and seen + len(words) > most:
                yield from sums()
                total[:], seen = 0, 0
            seen += len(words)
            for word, beside, first in ((words, left[history], 0), (history, right[words], classes + 1)):
                known = (word < size) & (beside >= 0)
                np.add.at(total.ravel(), word[known].astype(np.int64) * wide + first + beside[known], np.int32(1))
        yield from sums()

    names = [f"k{k}" for k in range(classes)]
    sums = (codes.mapInArrow(run, ", ".join(f"{c} long" for c in ["word", *names]))
            .groupBy("word").agg(*[F.sum(c).alias(c) for c in names]))
    place = F.array_position(F.array(*names), F.greatest(*names) if classes > 1 else F.col("k0")) - 1
    return sums.select("word", place.alias("class")).toArrow()          # one row per dictionary word


def spread(codes, size, seed_class, classes, sweeps=6, pairs=None):
    """(class of each dictionary word, transitions): batched exchange from the seeds' classes over the dictionary.

    The first sweep gives classes to the words that are no seeds, from neighbours that are and the seeds' `pairs`,
    which tell what classes follow each other where seeds are never side by side; words without such a neighbour take the
    class with most tokens, and have classed neighbours in the next sweep. From then on all words move at once,
    while the likelihood of the transitions grows.
    """
    own = np.concatenate([seed_class, np.full(size - len(seed_class), -1)]).astype(np.int64)
    moves = transitions(codes, own, classes)
    for sweep in range(sweeps if size else 0):
        new, evidence = own.copy(), moves.copy()
        if sweep == 0:
            new[own < 0] = moves[:, :classes].sum(0).argmax()
            if pairs is not None:
                member = np.eye(classes)[seed_class]
                evidence[:classes, :classes] += member.T @ pairs @ member
        found = best_classes(codes, own, evidence)
        word, kind = np.asarray(found["word"]), np.asarray(found["class"])
        free = (own[word] < 0) | (sweep > 0)
        new[word[free]] = kind[free]
        stays = np.isin(own, np.setdiff1d(own[own >= 0], new))      # a class that would lose all its words keeps them
        new[stays] = own[stays]
        if (new == own).all():
            break
        now = transitions(codes, new, classes)
        if sweep and likelihood(now) <= likelihood(moves):
            break
        own, moves = new, now
    return own, moves


def most_frequent(counts, size):
    """The `size` most frequent words, equal counts by spelling.

    A histogram of count classes gives the class in which the list ends; only words of it and above are
    sorted, so the one task that merges the order sees little more than the list.
    """
    level = F.floor(F.log2("n") * 16).cast("int")
    seen, least = 0, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # about 1,000 rows
        seen, least = seen + r["count"], r["level"]
        if seen >= size:
            break
    return counts.filter(level >= least).orderBy(F.desc("n"), "word").limit(size)


@in_small_batches
def learn(texts, classes=32, seeds=512, dictionary=200_000, weight=0.9, delta=0.5):
    """A model, a dict of small arrays and the word counts as a table, from texts (`_text`)."""
    counts = materialise(count_words(texts), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = texts.count()
    top = most_frequent(counts, dictionary).toArrow()
    words, n = top["word"].to_pylist(), np.asarray(top["n"]).astype(np.int64)
    size = len(words)
    seeds = min(seeds, size)
    classes = max(1, min(classes, seeds))
    codes = few_tasks(materialise(encode(texts, words), "codes"))
    pairs = seed_bigrams(codes, size, seeds) if seeds else np.zeros((0, 0))
    own, moves = spread(codes, size, exchange(pairs, classes), classes, pairs=pairs)

    in_class = np.bincount(own, n, classes)
    tail_tokens, tail_words = total[0] - int(n.sum()), total[1] - size
    mass = np.concatenate([in_class, [tail_tokens + delta, ends + delta]])
    usual = mass / mass.sum()
    seen = moves.sum(1, keepdims=True)
    given = np.where(seen > 0, weight * moves / np.maximum(seen, 1) + (1 - weight) * usual, usual)
    with np.errstate(divide="ignore"):
        log_given = np.log10(given)
    return {"counts": counts, "words": words, "n": n, "class": own, "log_given": log_given,
            "log_emit": np.log10(n / in_class[own]) if size else np.zeros(0),
            "tail_scale": tail_tokens + delta * (tail_words + 1), "delta": delta,
            "tokens": int(total[0] + ends), "distinct": int(total[1] + (ends > 0)), "ends": int(ends)}


@in_small_batches
def score(docs, model, text="text", key="doc_id"):
    """(key, copy, n_tokens, n_known, base_score, score) per row; log10 of the probability of the text."""
    spark = docs.sparkSession
    words, n = model["words"], model["n"]
    size, classes = len(words), model["log_given"].shape[1] - 2
    scale = math.log10(model["tokens"] + model["distinct"] + 1)
    end_base = math.log10(model["ends"] + 1) - scale
    shared = spark.sparkContext.broadcast((b"\n".join(words), n, model["class"].astype(np.int32),
                                           model["log_given"], model["log_emit"]))
    end_known = int(model["ends"] > 0)

    def run(batches):
        joined, n, own, given, emit = shared.value
        lookup = {w: i for i, w in enumerate(joined.split(b"\n"))} if joined else {}
        own = np.concatenate([own, [classes]])           # number -1 is the tail
        emit, base = np.concatenate([emit, [0.0]]), np.concatenate([np.log10(n + 1.0) - scale, [0.0]])
        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                out = {k: [] for k in ("n_tokens", "n_known", "base", "model", "tail")}
                for t in texts:
                    found = words_of(t)
                    ids = _numbers(lookup, found)
                    kinds = np.concatenate([own[ids], [classes + 1]])
                    # The nearest earlier dictionary word, or the start (history `classes`).
                    at = np.where(ids >= 0, np.arange(1, len(ids) + 1), 0)
                    last = np.maximum.accumulate(np.concatenate([[0], at]))
                    history = np.concatenate([[classes], own[ids]])[last]
                    out["n_tokens"].append(len(ids) + 1)
                    out["n_known"].append(int((ids >= 0).sum()) + end_known)
                    out["base"].append(float(base[ids].sum()) + end_base)
                    out["model"].append(float(given[history, kinds].sum() + emit[ids].sum()))
                    out["tail"].append(list(Counter(found[i] for i in np.flatnonzero(ids < 0)).items()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("_key"), rows.column("_copy"), pa.array(out["n_tokens"], pa.int64()),
                     pa.array(out["n_known"], pa.int64()), pa.array(out["base"], pa.float64()),
                     pa.array(out["model"], pa.float64()),
                     pa.array([[{"word": w, "n": c} for w, c in x] for x in out["tail"]],
                              pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))],
                    names=["_key", "_copy", "n_tokens", "n_known", "base", "model", "tail"])

    field = docs.schema[key].dataType.simpleString()
    body = F.col(f"`{text}`")
    scored = materialise(
        docs.select(F.col(f"`{key}`").alias("_key"), F.xxhash64(body).alias("_copy"), body.alias("_text"))
        .mapInArrow(run, f"_key {field}, _copy long, n_tokens long, n_known long, base double, "
                         "model double, tail array<struct<word:binary,n:long>>"), "scored")
    tail = scored.select("_key", "_copy", F.explode("tail").alias("t")).select("_key", "_copy", "t.word", "t.n")
    c = F.coalesce("c", F.lit(0))
    joined = tail.join(model["counts"].select("word", F.col("n").alias("c")), "word", "left")
    # Rows equal in id and text bring their words twice; they count once.
    joined = joined.groupBy("word", "_key", "_copy").agg(F.max("n").alias("n"), F.max("c").alias("c"))
    sums = joined.groupBy("_key", "_copy").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("n") * (F.log10(c + 1) - F.lit(scale))).alias("tail_base"),
        F.sum(F.col("n") * (F.log10(c + F.lit(model["delta"])) - F.lit(math.log10(model["tail_scale"]))))
        .alias("tail_model"))
    rows = scored.drop("tail").alias("s")
    sums = sums.alias("t")
    same = F.col("s._key").eqNullSafe(F.col("t._key")) & (F.col("s._copy") == F.col("t._copy"))
    plus = lambda a, b: F.round(F.col(a) + F.coalesce(b, F.lit(0)), 6)
    return rows.join(sums, same, "left").select(
        F.col("s._key").alias(key), F.col("s._copy").alias("copy"), "n_tokens",
        (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        plus("base", "tail_base").alias("base_score"), plus("model", "tail_model").alias("score"))
