import math
import tracemalloc
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from textscore.llm import brown_lm as lm
from tests.llm.helpers import docs, empty, odd_docs, words


def texts_of(df):
    return df.select(F.col("text").alias("_text"))


def test_base_score_against_brute_force(spark):
    texts = [" ".join(words(50, i, 60)) for i in range(30)] + [None, "", "UNSEEN words w1 W2"]
    df = docs(spark, texts)
    training = df.filter("doc_id < 25")
    model = lm.learn(texts_of(training), classes=4, seeds=12, dictionary=40)
    counts = Counter()
    for t in texts[:25]:
        counts.update(t.encode().lower().split() + [None])
    total, distinct = sum(counts.values()), len(counts)
    assert (model["tokens"], model["distinct"]) == (total, distinct)
    for r in lm.score(df, model).collect():
        tokens = (texts[r["doc_id"]] or "").encode().lower().split() + [None]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        assert abs(base - r["base_score"]) < 1e-5
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(counts[w] > 0 for w in tokens))


def probability_of_next(spark, model, history):
    """Log probabilities of a text of `history` and each word of the vocabulary, the end and an unseen word."""
    known = [bytes(r["word"]).decode() for r in model["counts"].collect()]
    rows = [(0, " ".join(history))] + [(i + 1, " ".join([*history, w])) for i, w in enumerate([*known, "neverseen"])]
    return {r["doc_id"]: r["score"] for r in lm.score(docs(spark, rows), model).collect()}, known


def test_probabilities_sum_to_one(spark):
    """P(w1 end) over all w1, each divided by P(end | w1), and P(end), is everything that can come first."""
    df = docs(spark, [" ".join(words(60, i, 50)) for i in range(20)])
    model = lm.learn(texts_of(df), classes=3, seeds=10, dictionary=25)
    scores, known = probability_of_next(spark, model, [])
    classes = model["log_given"].shape[1] - 2
    lookup = {w.decode(): i for i, w in enumerate(model["words"])}
    total = 10 ** scores[0]
    for i, w in enumerate([*known, "neverseen"]):
        history = model["class"][lookup[w]] if w in lookup else classes
        total += 10 ** (scores[i + 1] - model["log_given"][history, classes + 1])
    assert abs(total - 1) < 1e-3


def test_exchange_finds_alternating_classes():
    r = np.random.default_rng(1)
    left, right = np.arange(0, 20, 2), np.arange(1, 20, 2)
    bigrams = np.zeros((20, 20))
    for _ in range(4000):
        bigrams[r.choice(left), r.choice(right)] += 1
        bigrams[r.choice(right), r.choice(left)] += 1
    own = lm.exchange(bigrams, 2)
    assert len(set(own[left])) == 1 and len(set(own[right])) == 1 and own[0] != own[1]


def test_classes_beat_the_unigram_on_held_out_text(spark):
    """Two vocabularies that never mix: the class of the history tells which one comes next."""
    make = lambda i: " ".join(f"{'ab'[i % 2]}{w}" for w in words(80, i, 40))
    df = docs(spark, [make(i) for i in range(120)])
    model = lm.learn(texts_of(df.filter("doc_id < 100")), classes=2, seeds=60, dictionary=100)
    held = lm.score(df.filter("doc_id >= 100"), model).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_odd_rows(spark):
    df = odd_docs(spark)
    rows = lm.score(df, lm.learn(texts_of(df), classes=2, seeds=5, dictionary=10)).collect()
    assert len(rows) == 10
    same = [r for r in rows if r["doc_id"] == 6]
    assert same[0] == same[1]
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (1, 2, 3, 7))
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    nothing = lm.learn(texts_of(empty(spark)))
    assert lm.score(empty(spark), nothing).collect() == []
    found = lm.score(docs(spark, [""]), nothing).first()
    assert abs(found["score"] - math.log10(0.5)) < 1e-5


def test_transitions_count_every_token(spark):
    """The history is the class of the nearest earlier dictionary word, seed or not, as in the scores."""
    texts = [" ".join(words(80, i, 60)) for i in range(25)] + [None, ""]
    model = lm.learn(texts_of(docs(spark, texts)), classes=4, seeds=8, dictionary=40, weight=1.0)
    own = dict(zip(model["words"], model["class"].tolist()))
    moves = np.zeros((5, 6))
    for t in texts:
        history = 4
        for w in (t or "").encode().lower().split():
            moves[history, own.get(w, 4)] += 1
            history = own.get(w, history)
        moves[history, 5] += 1
    expected = moves / moves.sum(1, keepdims=True)
    assert np.allclose(10 ** model["log_given"], expected)


def test_words_that_never_follow_a_seed_get_their_class(spark):
    """Rare words in a row: only the first of each row is beside a seed, the kind of all shows in what comes after."""
    texts = []
    for i in range(400):
        kind = "ab"[i % 2]
        rare = [f"{kind}{p}r{(i // 2 * 7 + p) % 40}" for p in range(3)]
        texts.append(" ".join([f"{kind}s{i % 3}", *rare, f"{kind}s{(i + 1) % 3}"]))
    model = lm.learn(texts_of(docs(spark, texts)), classes=2, seeds=6, dictionary=300)
    own = dict(zip(model["words"], model["class"].tolist()))
    kinds = {k: {c for w, c in own.items() if w.decode()[0] == k} for k in "ab"}
    assert len(own) == 246 and len(kinds["a"]) == len(kinds["b"]) == 1 and kinds["a"] != kinds["b"]


def test_sweeps_do_not_lower_the_likelihood(spark):
    texts = [" ".join(words(80, i, 120)) for i in range(25)]
    df = texts_of(docs(spark, texts))
    names = [bytes(r["word"]) for r in lm.most_frequent(lm.count_words(df), 90).collect()]
    codes = lm.encode(df, names).cache()
    seeds = lm.exchange(lm.seed_bigrams(codes, 90, 30), 3)
    values = [lm.likelihood(lm.spread(codes, 90, seeds, 3, sweeps)[1]) for sweeps in (1, 2, 6)]
    assert values == sorted(values) and values[0] < values[2]


def test_neighbours_are_counted_in_little_memory(spark):
    """A task holds four bytes a cell, and sums sent several times make the same classes."""
    df = texts_of(docs(spark, [" ".join(words(80, i, 120)) for i in range(25)]))
    names = [bytes(r["word"]) for r in lm.most_frequent(lm.count_words(df), 90).collect()]
    codes = lm.encode(df.repartition(8), names).repartition(1).cache()
    assert codes.count() > 1
    own = np.arange(90) % 3
    moves = lm.transitions(codes, own, 3)
    once = lm.best_classes(codes, own, moves).sort_by("word")
    assert lm.best_classes(codes, own, moves, most=100).sort_by("word") == once

    batches = codes.toArrow().to_batches()

    class Task:
        """Runs the task's function here, for a dictionary of 50,000 words."""
        sparkSession = spark

        def mapInArrow(self, run, schema):
            tracemalloc.start()
            self.rows = sum(b.num_rows for b in run(iter(batches)))
            self.peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return codes.selectExpr("1L AS word", *[f"0L AS k{k}" for k in range(32)])

    task = Task()
    lm.best_classes(task, np.arange(50_000) % 32, np.ones((33, 34)))
    assert task.rows and task.peak < 6 * 50_000 * 67


def test_sums_of_the_dictionary_grow_with_the_text_not_with_files(spark, monkeypatch):
    """A task of a sweep sends a row for each dictionary word it holds, so a table of many files must not make many tasks."""
    seen = []
    for name in ("seed_bigrams", "transitions", "best_classes"):
        def counted(codes, *args, do=getattr(lm, name), **kwargs):
            seen.append(codes.rdd.getNumPartitions())
            return do(codes, *args, **kwargs)
        monkeypatch.setattr(lm, name, counted)
    files = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        texts = texts_of(docs(spark, [" ".join(words(80, i, 120)) for i in range(60)])).repartition(40)
        lm.learn(texts, classes=3, seeds=30, dictionary=90)
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", files)
    assert len(seen) > 3 and max(seen) == 1
