import pytest
from pyspark.sql import functions as F

from textscore.functions import text
from textscore.operators import joins
from textscore.plans import report, speakers, tokens


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c"))).first()[0]


def test_tokens(spark):
    def cut(value, stop=("the", "do", "we")):
        return one(spark, lambda c: text.tokens(c, stop), value)

    assert cut("The 3rd Tax-Cut, we don't, We're JOHN'S; isn’t it?") == [
        "tax", "cut", "john", "is", "it"]
    assert cut("Élève 42 naïve x2 ＡＢ") == ["élève", "naïve", "ａｂ"]
    assert cut("") == [] and cut("  123 !!") == []
    assert cut(None) is None


def test_stopwords_are_tested_before_the_lemma(spark, rows):
    df = spark.createDataFrame([(1, "Doing jobs to DO taxes")], "id int, t string")
    cut = tokens.tokenise(df, "t", stopwords=["do", "to"])
    lemmas = spark.createDataFrame([("doing", "do"), ("jobs", "Job")], "form string, lemma string")
    lemmatised = tokens.lemmatise(tokens.token_rows(cut, ["id"]), lemmas, ["id"])
    assert rows(tokens.token_arrays(lemmatised, ["id"])) == [(1, ["do", "job", "taxes"])]


@pytest.mark.parametrize("small", [True, False])
def test_lemmas_of_arrays(spark, rows, monkeypatch, small):
    """One answer for small and large lemma tables; NULL, empty and equal rows stay as they are."""
    monkeypatch.setattr(joins, "has_at_most", lambda *a, **k: small)
    df = spark.createDataFrame([(1, ["Doing", "x", "jobs", "jobs"]), (2, []), (3, None), (4, ["x"]), (4, ["x"])],
                               "id int, tokens array<string>")
    lemmas = spark.createDataFrame([("doing", "do"), ("jobs", "Job"), ("jobs", "Zob"), ("x", None)],
                                   "form string, lemma string")
    assert rows(tokens.lemmatise_arrays(df, lemmas, "tokens"), "id") == [
        (1, ["do", "x", "job", "job"]), (2, []), (3, None), (4, ["x"]), (4, ["x"])]


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("lowercase", [True, False])
def test_lemmas_in_place_and_joined(spark, rows, monkeypatch, small, lowercase):
    """Forms are looked up in lower case; missing forms and lemmas, NULL arrays and an empty table change nothing."""
    if not small:
        monkeypatch.setattr(tokens, "has_at_most", lambda *a, **k: False)
    df = spark.createDataFrame([(k, value) for k in range(50) for value in (["Doing", "Élèves", "X", "Doing"], [], None, ["y"])],
                               "id int, tokens array<string>").repartition(3)
    lemmas = spark.createDataFrame([("doing", "Do"), ("élèves", "Élève"), ("x", None), (None, "z"), ("unused", "w")],
                                   "form string, lemma string")
    cut = ["do", "élève", "x", "do"] if lowercase else ["Do", "Élève", "X", "Do"]
    found = tokens.lemmatise_arrays(df, lemmas, "tokens", lowercase)
    assert found.columns == df.columns
    assert sorted(rows(found), key=str) == sorted(((k, v) for k in range(50) for v in (cut, [], None, ["y"])), key=str)
    same = tokens.lemmatise_arrays(df, lemmas.limit(0), "tokens", lowercase)
    assert sorted(rows(same.where("id = 3")), key=str) == sorted(
        rows(df.where("id = 3").select("id", F.transform("tokens", F.lower) if lowercase else "tokens")), key=str)


def test_lemmas_move_no_token(spark, tmp_path, monkeypatch):
    """Arrays are rewritten where they are: nothing but the lemma table is shuffled or written."""
    written = []
    monkeypatch.setattr(tokens, "materialise", lambda df, name, real=tokens.materialise: written.append(df.columns) or real(df, name))
    spark.range(40).select("id", F.array(F.lit("jobs"), F.lit("tax")).alias("tokens")).write.parquet(str(tmp_path / "docs"))
    lemmas = spark.createDataFrame([("jobs", "job")], "form string, lemma string")
    found = tokens.lemmatise_arrays(spark.read.parquet(str(tmp_path / "docs")), lemmas)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and "Join" not in plan
    assert written == [["form", "lemma"]]
    assert found.where(F.col("tokens") == F.array(F.lit("job"), F.lit("tax"))).count() == 40


def test_a_long_lemma_table_moves_listed_tokens_alone(spark, monkeypatch):
    sides, real = [], tokens.lookup_join
    monkeypatch.setattr(tokens, "has_at_most", lambda *a, **k: False)
    monkeypatch.setattr(tokens, "lookup_join", lambda big, dim, *a, **k: sides.append(big) or real(big, dim, *a, **k))
    word = lambda c: F.concat(F.lit("w"), F.translate(c.cast("string"), "0123456789", "abcdefghij"), F.lit("s"))
    df = spark.range(500).select("id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: word(F.col("id") * 10 + k)).alias("tokens"))
    lemmas = spark.range(0, 5000, 50).select(word(F.col("id")).alias("form"), F.lit("found").alias("lemma"))
    found = tokens.lemmatise_arrays(df, lemmas)
    count = F.aggregate("tokens", F.lit(0), lambda n, t: n + (t == "found").cast("int"))
    assert found.agg(F.sum(count), F.sum(F.size("tokens"))).first() == (100, 5000)
    assert found.where((F.get("tokens", F.lit(0)) == "found") != (F.col("id") % 5 == 0)).count() == 0
    assert 100 <= sides[0].count() < 2000


@pytest.mark.parametrize("small", [True, False])
def test_stopwords_from_a_table(spark, rows, monkeypatch, small):
    """The same as a list's, broadcast or joined; NULL, empty and equal rows stay as they are."""
    if not small:
        monkeypatch.setattr(joins, "has_at_most", lambda *a, **k: False)
        monkeypatch.setattr(tokens, "has_at_most", lambda *a, **k: False)
    values = ["The tax AND the Élève and x", "the and", "", None, "x x THE y", "x x THE y"]
    df = spark.createDataFrame(list(enumerate(values)), "id int, t string").union(
        spark.createDataFrame([(4, "x x THE y")], "id int, t string"))
    stop = ["the", "AND", "élève"]
    table = spark.createDataFrame([(" The",), ("and ",), ("and",), ("",), (None,), ("ÉLÈVE",)], "word string")
    for lowercase in (True, False):
        expected = tokens.tokenise(df, "t", stopwords=stop, lowercase=lowercase)
        found = tokens.tokenise(df, "t", stopwords=table, lowercase=lowercase)
        assert found.columns == expected.columns
        assert rows(found, "id", "tokens") == rows(expected, "id", "tokens")
    assert rows(tokens.tokenise(df, "t", stopwords=table.limit(0)), "id") == rows(tokens.tokenise(df, "t", stopwords=()), "id")


def test_a_million_stopwords(spark):
    """Words of the table are letters only, as tokens are; every second number is a stopword."""
    spell = lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    table = spark.range(0, 2_000_000, 2).select(spell(F.col("id")).alias("word"))
    texts = spark.range(2000).select("id", F.concat_ws(" ", spell(F.col("id")), spell(F.col("id") + 1_000_001)).alias("t"))
    found = tokens.tokenise(texts, "t", stopwords=table)
    odd = F.when(F.col("id") % 2 == 1, spell(F.col("id"))).otherwise(spell(F.col("id") + 1_000_001))
    assert found.where(F.col("tokens") == F.array(odd)).count() == 2000


def test_switches(spark):
    df = spark.createDataFrame([("The Tax",)], "t string")
    kept = tokens.tokenise(df, "t", remove_stopwords=False, lowercase=False).first()
    assert kept["tokens"] == ["The", "Tax"] and kept["token_count"] == 2
    assert tokens.tokenise(df, "t").first()["tokens"] == ["tax"]


def test_user_tokeniser(spark):
    df = spark.createDataFrame([("a b",), ("c",)], "t string")
    cut = tokens.tokenise_with(df, "t", lambda: lambda texts: [x.split() for x in texts])
    assert [(r["tokens"], r["token_count"]) for r in cut.collect()] == [(["a", "b"], 2), (["c"], 1)]


def test_ngrams(spark):
    def grams(value, n=2):
        return one(spark, lambda c: text.ngrams(c, n), value, "array<string>")

    assert grams(["x", "y", "z"]) == ["x y", "y z"]
    assert grams(["x"]) == [] and grams([]) == []
    assert grams(["x", "y", "z", "w"], 3) == ["x y z", "y z w"] and grams(["x", "y"], 3) == []


def speeches(spark):
    return spark.createDataFrame([
        ("s", 1, None, ["a", "b"]), ("s", 2, 0.7, []), ("s", 3, 0.8, ["c"]),
        ("t", 1, 0.1, []), (None, 1, 0.5, ["z"])],
        "unique_id string, speech_id int, dime double, tokens array<string>")


def test_speaker_scores(spark, rows):
    assert rows(speakers.speaker_scores(speeches(spark)), "unique_id") == [
        ("s", 0.7, 3, 3), ("t", 0.1, 1, 0)]


def test_speaker_tokens_and_chunks(spark, rows):
    listed = speakers.speaker_tokens(speeches(spark))
    assert rows(listed, "unique_id", "pos") == [("s", 0, "a"), ("s", 1, "b"), ("s", 2, "c")]
    assert rows(speakers.speaker_chunks(speeches(spark), size=2), "chunk") == [
        ("s", 0, ["a", "b"]), ("s", 1, ["c"])]


@pytest.mark.parametrize("size", [1, 3, 4, 50])
def test_repeated_order_values_double_nothing(spark, rows, size):
    """Two score rows of one cycle leave a speech twice under one order; each copy has its own place."""
    data = [("s", 1, 2016, list("abcdef")), ("s", 1, 2016, list("abcdef")), ("s", 2, 2016, None),
            ("s", 3, 2014, ["x"]), ("t", 1, 2016, ["q"])]
    df = spark.createDataFrame(data, "unique_id string, speech_id int, cycle int, tokens array<string>")
    listed = rows(speakers.speaker_tokens(df, ["speech_id", "cycle"]), "unique_id", "pos")
    whole = list("abcdefabcdefx")
    assert listed == [*[("s", k, w) for k, w in enumerate(whole)], ("t", 0, "q")]
    chunks = rows(speakers.speaker_chunks(df, ["speech_id", "cycle"], size=size), "unique_id", "chunk")
    assert chunks == [*[("s", k // size, whole[k:k + size]) for k in range(0, 13, size)], ("t", 0, ["q"])]


def test_speaker_tokens_over_many_slices(spark, rows):
    """One speaker with most speeches is cut into slices and still comes out in order."""
    df = spark.range(600).select(
        F.when(F.col("id") < 400, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("unique_id"),
        F.col("id").alias("speech_id"),
        F.transform(F.sequence(F.lit(0), F.col("id") % 4), lambda i: F.concat(
            F.col("id").cast("string"), F.lit("."), i.cast("string"))).alias("tokens"))
    expected = {}
    for r in df.orderBy("speech_id").collect():
        expected.setdefault(r["unique_id"], []).extend(r["tokens"])
    got = {}
    for key, pos, term in rows(speakers.speaker_tokens(df), "unique_id", "pos"):
        got.setdefault(key, []).append(term)
        assert pos == len(got[key]) - 1
    assert got == expected


def test_token_stats(spark):
    df = spark.createDataFrame([(1,), (2,), (5,), (10,)], "token_count int")
    assert report.token_stats(df).first().asDict() == {
        "rows": 4, "mean_tokens": 4.5, "min_tokens": 1, "max_tokens": 10, "median_tokens": 3.5}
