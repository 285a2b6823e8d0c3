from pyspark.sql import functions as F

from textscore.llm import decontaminate as dc
from tests.llm.helpers import docs, empty, odd_docs, words

ITEM = ("A train leaves the old station at 9 with 120 kg of apples and meets Maria after 9 hours, so how many "
        "apples does every porter carry along the platform?")


def items(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def found(df, bench, **options):
    return {(r["doc_id"], r["item_id"]): (r["n_windows"], r["item_windows"])
            for r in dc.matches(df, bench, **options).collect()}


def test_exact_and_reparameterised_questions_match(spark):
    other = ITEM.replace("9", "14").replace("120", "3,500").replace("Maria", "Ivan").replace("kg", "pounds")
    broken = ITEM.replace("at 9", "at 14", 1)              # one 9 became 14, the other stayed
    texts = ["Some words before. " + ITEM + " And after.", other.upper().lower().replace("ivan", "Ivan"), broken,
             " ".join(words(60, 1)), ITEM.replace("apples", "pears"), None, ""]
    hits = found(docs(spark, texts), items(spark, [ITEM, None, "", "too short"]))
    assert (0, 0) in hits and (1, 0) in hits and (2, 0) not in hits
    assert not any(d in (3, 5, 6) for d, _ in hits) and not any(i > 0 for _, i in hits)
    assert hits[0, 0][0] == hits[0, 0][1]


def test_windows_are_those_of_a_plain_search(spark):
    """Without slots the matches are the shared runs of ten words."""
    bench = [" ".join(words(30, i, 10 ** 6)) for i in range(5)]
    texts = [" ".join(words(50, 100 + i, 10 ** 6) + bench[i % 5].split()[i % 7:i % 7 + 10 + i] + words(5, i + 900, 10 ** 6))
             for i in range(20)]
    runs = lambda t: [tuple(t.split()[k:k + 10]) for k in range(len(t.split()) - 9)]
    expected = {(d, i): len(set(runs(t)) & set(runs(b))) for d, t in enumerate(texts) for i, b in enumerate(bench)
                if set(runs(t)) & set(runs(b))}
    assert {k: v[0] for k, v in found(docs(spark, texts), items(spark, bench)).items()} == expected


def test_short_items_and_rows_of_numbers_match_by_their_words(spark):
    numbers = "Add 12 34 56 78 90 12 34 56 78 and say what you get in the end"
    bench = items(spark, ["Which river crosses seven old towns?", "Name one river", numbers])
    texts = ["so which river crosses seven old TOWNS, they asked", "name one river", "which river crosses seven new towns",
             "list: 12 34 56 78 90 12 34 56 78 and more", "list: 12 34 56 78 91 12 34 56 78 and more"]
    hits = found(docs(spark, texts), bench)
    assert set(hits) == {(0, 0), (3, 2)} and hits[0, 0] == (1, 1)
    assert found(docs(spark, [numbers]), bench) == {(0, 2): (9, 9)}
    assert set(found(docs(spark, texts), bench, least=3)) == {(0, 0), (1, 1), (3, 2)}


def test_any_outer_punctuation_is_cut():
    c = dc.Canonical([b'"((([Hello]))))))!!! ... ******* x"""""""" -', b"", b"!!!!!!", b"a-b."])
    assert c.count.tolist() == [2, 0, 0, 1]
    assert (c.value == dc.Words([b"hello x a-b"]).hash).all()


def test_odd_rows_and_removal(spark):
    df = odd_docs(spark)
    bench = items(spark, [df.filter("doc_id = 6").first()["text"]] * 2 + [None])
    assert sorted({k[0] for k in found(df, bench)}) == [6]
    left = dc.remove_contaminated(df, bench)
    assert left.columns == df.columns and left.count() == 8
    assert found(empty(spark), bench) == {} and found(df, items(spark, []).limit(0)) == {}


def test_texts_under_one_item_id_are_compared_one_by_one(spark):
    """The second text of item 7 says 14 where the first says 9: mixed up, no alignment would be consistent."""
    rows = [(7, ITEM), (7, ITEM.replace("9", "14")), (7, ITEM), (7, ITEM + " Give the number in full words, please, with a reason.")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    alone = found(docs(spark, [ITEM]), items(spark, [ITEM]))[0, 0]
    assert found(docs(spark, [ITEM, " ".join(words(60, 1))]), bench) == {(0, 7): alone}
    assert dc.remove_contaminated(docs(spark, [ITEM, "clean"]), bench).count() == 1


def test_clashing_names_stay(spark):
    df = docs(spark, [ITEM, " ".join(words(60, 1))])
    for name in ("_doc", "_copy", "__doc", "copy", "_item", "at", "_Text"):
        df = df.withColumn(name, F.lit("mine"))
    left = dc.remove_contaminated(df, items(spark, [ITEM])).collect()
    assert [(r["doc_id"], r["_doc"], r["_copy"]) for r in left] == [(1, "mine", "mine")]


def test_canonical_forms():
    c = dc.Canonical([b"He met Anna at 10:30, paying 5 dollars. Dollars? (Twice)"])
    number, name, unit = c.form == dc.NUMBER, c.form == dc.NAME, c.form == dc.UNIT
    assert number.tolist() == [False] * 4 + [True, False, True] + [False] * 3
    assert name.tolist() == [False, False, True] + [False] * 7
    assert unit.tolist() == [False] * 7 + [True] + [False] * 2
