import math
import random
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from textscore.operators import grid, joins, terms

ADS = [["tax", "cut", "tax"], ["cut", "job"], ["job", "tax"], ["tax"]]


def docs(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "id int, tokens array<string>")


def test_vocabulary_bounds_are_inclusive(spark):
    known = {r["term"]: r for r in terms.fit_vocabulary(docs(spark, ADS), 2, 0.75).collect()}
    assert {t: r["df"] for t, r in known.items()} == {"tax": 3, "cut": 2, "job": 2}
    assert known["tax"]["idf"] == pytest.approx(1.2231435513)
    assert known["cut"]["idf"] == pytest.approx(1.5108256238)
    assert terms.fit_vocabulary(docs(spark, ADS), 2, 0.7).count() == 2


def test_empty_documents_count(spark):
    known = terms.fit_vocabulary(docs(spark, [["a"], [], []]), 1, 1.0).first()
    assert known["df"] == 1 and known["idf"] == pytest.approx(math.log(4 / 2) + 1)


def test_max_features(spark):
    lists = [["a", "a", "a", "b"], ["b", "c"], ["d"]]
    kept = terms.fit_vocabulary(docs(spark, lists), max_features=3)
    assert sorted(r["term"] for r in kept.collect()) == ["a", "b", "c"]


def test_transform(spark, rows):
    units = spark.createDataFrame([("s", ["tax", "tax", "cut", "zebra"]), ("z", ["zebra"])],
                                  "key string, tokens array<string>")
    known = terms.fit_vocabulary(docs(spark, ADS), 2, 0.75)
    out = terms.tfidf(terms.term_counts(units, "key"), known, "key")
    got = {(r["key"], r["term"]): r["tfidf"] for r in out.collect()}
    assert got == {("s", "tax"): pytest.approx(0.850816, abs=1e-6),
                   ("s", "cut"): pytest.approx(0.525464, abs=1e-6)}


@pytest.mark.parametrize("max_ngram", [1, 2, 3, 4])
@pytest.mark.parametrize("small", [True, False])
def test_counts_equal_those_of_the_joined_text(spark, monkeypatch, max_ngram, small):
    """N-grams across rows, with empty and one-token rows and a hot key."""
    monkeypatch.setattr(joins, "has_at_most", lambda *a, **k: small)
    rng = random.Random(max_ngram)
    data = [("hot" if rng.random() < 0.6 else rng.choice("ab"), i,
             [rng.choice("xyzw") for _ in range(rng.choice([0, 0, 1, 1, 2, 6]))]) for i in range(300)]
    df = spark.createDataFrame(data, "key string, id int, tokens array<string>")
    expected = Counter()
    for key in ("hot", "a", "b"):
        joined = [t for k, _, ts in data if k == key for t in ts]
        for n in range(1, max_ngram + 1):
            expected.update((key, n, " ".join(joined[i:i + n])) for i in range(len(joined) - n + 1))
    known = spark.createDataFrame([(1, "x"), (2, "x y"), (3, "q")], "ngram int, term string")
    got = {(r["key"], r["ngram"], r["term"]): r["tf"]
           for r in terms.term_counts(df, "key", ["id"], max_ngram).collect()}
    assert got == expected
    some = terms.term_counts(df, "key", ["id"], max_ngram, vocabulary=known).collect()
    wanted = {(1, "x"), (2, "x y")}
    assert {(r["key"], r["ngram"], r["term"]): r["tf"] for r in some} == {
        k: v for k, v in expected.items() if k[1:] in wanted}


def test_same_as_count_vectorizer(spark):
    """Long form against Spark ML's own vectorizer, scaled to the smooth idf."""
    from pyspark.ml.feature import CountVectorizer, Normalizer

    rng = random.Random(3)
    lists = [[rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    df = docs(spark, lists)
    model = CountVectorizer(inputCol="tokens", outputCol="counts").fit(df)
    idf = {r["term"]: r["idf"] for r in terms.fit_vocabulary(df).collect()}
    assert set(model.vocabulary) == set(idf)
    weights = F.array([F.lit(idf[t]) for t in model.vocabulary])
    from pyspark.ml.functions import array_to_vector

    scaled = model.transform(df).withColumn("x", array_to_vector(F.zip_with(
        vector_to_array("counts"), weights, lambda a, b: a * b)))
    vectors = Normalizer(inputCol="x", outputCol="n").transform(scaled).select("id", vector_to_array("n").alias("n"))
    expected = {(r["id"], t): v for r in vectors.collect() for t, v in zip(model.vocabulary, r["n"]) if v}
    out = terms.tfidf(terms.term_counts(df, "id"), terms.fit_vocabulary(df), "id")
    got = {(r["id"], r["term"]): r["tfidf"] for r in out.collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in expected.items()}


def test_vectors_and_wide_table(spark, rows):
    weights = spark.createDataFrame([("s", 1, "b", 0.6), ("s", 1, "c", 0.8), ("t", 1, "a", 1.0)],
                                    "key string, ngram int, term string, tfidf double")
    known = spark.createDataFrame([(1, t) for t in "abcd"], "ngram int, term string")
    vectors = terms.sparse_vectors(weights, known, "key").orderBy("key").collect()
    assert [list(r["features"].toArray()) for r in vectors] == [[0, 0.6, 0.8, 0], [1, 0, 0, 0]]
    assert rows(terms.wide(weights, "key", ["a", "c"]), "key") == [("s", 0, 0.8), ("t", 1.0, 0)]


def test_grid_vocabularies_equal_one_by_one(spark):
    rng = random.Random(4)
    lists = [[rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(0, 9))] for _ in range(60)]
    df = docs(spark, lists).cache()
    parameters = grid.Grid([2, 5, 30], [0.02, 0.3, 0.9], [1, 2])
    cells = parameters.cells(terms.document_frequency(df, 2), F.lit(60)).cache()
    sizes = {r["config"]: r for r in parameters.vocabularies(cells, F.lit(60), 5).collect()}
    assert sorted(sizes) == list(range(18))
    for config, row in sizes.items():
        expected = terms.fit_vocabulary(df, row["min_df"], row["max_df"], row["max_ngram"])
        assert row["vocab_size"] == expected.count() == cells.where(parameters.has_cell(config)).count()
        assert parameters.number(row["min_df"], row["max_df"], row["max_ngram"]) == config
    assert sizes[0]["error"] == grid.BOUNDS_ERROR
    assert {r["error"] is None for r in sizes.values()} == {True, False}


def test_grid_size(spark):
    from textscore import settings

    parameters = grid.Grid(settings.MIN_DF, settings.MAX_DF, settings.MAX_NGRAM)
    points = parameters.with_alphas(parameters.frame(spark), settings.ALPHAS)
    got = points.orderBy("grid_pos").collect()
    assert [r["grid_pos"] for r in got] == list(range(280))
    assert (got[6]["min_df"], got[6]["max_df"], got[6]["max_ngram"], got[6]["ridge_alpha"]) == (2, 0.01, 2, 1.0)


def test_norms(spark):
    rng = random.Random(5)
    df = docs(spark, [[rng.choice("abcdef") for _ in range(5)] for _ in range(30)])
    out = terms.tfidf(terms.term_counts(df, "id"), terms.fit_vocabulary(df, 2, 0.9), "id")
    for row in out.groupBy("id").agg(F.sum(F.col("tfidf") ** 2).alias("s")).collect():
        assert row["s"] == pytest.approx(1.0, abs=1e-12)


def test_terms_past_the_broadcast_limit_are_joined_not_broadcast(spark):
    """About 200,000 terms were built into one table in the driver, several times a query."""
    known = spark.range(30_000).select(F.concat(F.lit("t"), "id").alias("term"), F.lit(1).alias("ngram"),
                                       F.lit(2).alias("df"), F.lit(1.0).alias("idf"))
    units = spark.range(40).select((F.col("id") % 3).cast("string").alias("key"), F.transform(
        F.sequence(F.col("id") * 997, F.col("id") * 997 + 400), lambda i: F.concat(F.lit("t"), i.cast("string"))).alias("tokens"))
    out = terms.weigh(terms.term_counts(units, "key", vocabulary=known), known, "key")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1 and "_words" in plan
    expected = Counter((r["key"], t) for r in units.collect() for t in r["tokens"] if int(t[1:]) < 30_000)
    assert {(r["key"], r["term"]): r["tf"] for r in out.collect()} == expected


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_likely_in_keeps_all_and_drops_most(spark, n):
    dim = spark.range(n).select(F.col("id").cast("string").alias("term"))
    big = spark.range(20_000).select("id", F.col("id").cast("string").alias("term"))
    kept = {r["id"] for r in joins.likely_in(big, dim, ["term"]).collect()}
    assert kept >= set(range(n)) and len(kept) - n < 0.1 * 20_000


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("windows, held", [(3, 1), (7, 40), (terms.WINDOWS, terms.HELD)])
def test_ngram_counts_of_any_run_length(spark, monkeypatch, n, windows, held):
    """What a task counts at once ends anywhere: in a row, at its end, in a gram that goes over two runs."""
    monkeypatch.setattr(terms, "WINDOWS", windows)
    monkeypatch.setattr(terms, "HELD", held)
    rng = random.Random(n)
    lists = [None, [], ["a"], ["a", "b"], [], *[[rng.choice("abcé") for _ in range(rng.randrange(9))] for _ in range(60)], None, ["b"]]
    expected = Counter(" ".join(x[i:i + n]) for x in lists if x for i in range(len(x) - n + 1))
    found = terms.ngram_counts(docs(spark, lists).coalesce(1), n)
    assert {r["term"]: r["occurrences"] for r in found.collect()} == expected
    assert found.count() == len(expected)


def test_ngram_counts_hold_no_task_wide_table(spark, monkeypatch):
    """Before n-grams are dealt by term, no aggregate of the engine holds a task's whole share, and frequent ones are few rows."""
    monkeypatch.setattr(terms, "HELD", 1000)
    many = spark.range(2000, numPartitions=2).select(F.array(F.lit("tax"), F.lit("cut"), F.col("id").cast("string")).alias("tokens"))
    found = terms.ngram_counts(many, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = plan[plan.index("Exchange"):]
    assert plan.count("Exchange") == 1 and "Aggregate" not in dealt and "MapInArrow" in dealt
    counts = {r["term"]: r["occurrences"] for r in found.collect()}
    assert counts["tax cut"] == 2000 and counts["cut 7"] == 1 and len(counts) == 2001
