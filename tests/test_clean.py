import pytest

from pyspark.sql import functions as F

from textscore.catalog import cleaning
from textscore.operators import joins
from textscore.plans import clean

LONG = "x" * 60


def scores(spark):
    rows = [(2014, "federal:house", "smith", "2014_TX_1", 0.1, 50.0, "W"),
            (2016, "federal:house", "Smith J", "2016_TX_1", 0.3, float("nan"), "L"),
            (2012, "federal:house", "smith", "2012_TX_1", 9.0, 1.0, "W"),
            (2016, "state:house", "smith", "2016_TX_1", 8.0, 1.0, "W"),
            (2018, "federal:senate", "Reed", "2018_RI_S", -0.2, 60.0, "W"),
            (2018, "federal:senate", "Nope", "2018", -0.9, 60.0, "W")]
    df = spark.createDataFrame(rows, "cycle int, seat string, lname string, distcyc string, "
                                     "dwdime double, `gen.vote.pct` double, gwinner string")
    return clean.clean_scores(df)


def speeches(spark):
    speakers = spark.createDataFrame(
        [(7, 1, "Smith", "A", "TX", 1.0), (7, 2, "Smith", "A", "TX", 1.0),
         (8, 3, "Reed", "B", "RI", None), (9, 4, "", "C", "RI", None)],
        "speakerid long, speech_id long, lastname string, firstname string, state string, "
        "district double")
    texts = spark.createDataFrame(
        [(1, LONG), (2, LONG + "y"), (3, "short"), (4, LONG), (5, LONG)],
        "speech_id long, speech string")
    return clean.keyed_speeches(speakers, texts)


def test_scores_filtered_and_keyed(spark, rows):
    got = rows(scores(spark).select("cycle", "unique_id", "gen_vote_pct"), "cycle", "unique_id")
    assert got == [(2014, "SMITH_TX_1", 50.0), (2016, "SMITH_TX_1", None),
                   (2018, None, 60.0), (2018, "REED_RI_S", 60.0)]


def test_speeches_need_a_name(spark, rows):
    assert rows(speeches(spark).select("speech_id", "unique_id"), "speech_id") == [
        (1, "SMITH_TX_1"), (2, "SMITH_TX_1"), (3, "REED_RI_S")]


def test_right_join_becomes_inner(spark):
    plan = speeches(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "RightOuter" not in plan


@pytest.mark.parametrize("bound", [joins.BROADCAST_ROWS, 0])
def test_fan_out_and_latest(spark, rows, monkeypatch, bound):
    """Both ways to join, the broadcast one and the salted one."""
    real = clean.lookup_join
    monkeypatch.setattr(clean, "lookup_join",
                        lambda *a, **k: real(*a, **{**k, "max_rows": bound}))
    fan = clean.join_scores(speeches(spark), scores(spark))
    assert rows(fan.select("speech_id", "dime"), "speech_id", "dime") == [
        (1, 0.1), (1, 0.3), (2, 0.1), (2, 0.3)]
    assert fan.columns == clean.SPEECH_COLUMNS
    latest = clean.join_scores(speeches(spark), scores(spark), dedup="latest", min_length=0)
    assert rows(latest.select("speech_id", "dime"), "speech_id") == [(1, 0.3), (2, 0.3), (3, -0.2)]


def test_score_join_becomes_inner(spark):
    plan = clean.join_scores(speeches(spark), scores(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan


@pytest.mark.parametrize("missing", [False, True])
def test_characters_may_take_the_place_of_the_speech(spark, rows, missing):
    plain = clean.join_scores(speeches(spark), scores(spark), match_missing=missing)
    counted = clean.join_scores(speeches(spark), scores(spark), match_missing=missing, chars="n")
    assert counted.columns == ["n" if c == "speech" else c for c in plain.columns]
    assert rows(counted, "speech_id", "dime") == rows(
        plain.withColumn("speech", F.length("speech")), "speech_id", "dime") != []


def test_characters_are_counted_before_a_speech_is_repeated(spark, rows, monkeypatch):
    tables = {"documents": spark.createDataFrame([(1, LONG, "en", "src1"), (2, None, "en", "src1"), (3, "s", "de", "src2")],
                                                 "doc_id long, text string, lang string, source string"),
              "supplier": spark.createDataFrame([(k, 1 + k % 2, 1.0 * k) for k in range(-2, 4)],
                                                "s_suppkey long, s_nationkey int, s_acctbal double")}
    monkeypatch.setattr(cleaning, "table", lambda spark, sf, name: tables[name])
    found = cleaning.score_left_join_fanout(spark, "")
    assert rows(found, "dime") == [(1, "src1", "en", 0.0, 60), (1, "src1", "en", 2.0, 60)]
    above, _, below = found._jdf.queryExecution().optimizedPlan().toString().partition("Join Inner")
    assert below and "length(" not in above and "speech#" not in above


@pytest.mark.parametrize("size", [2, 1 << 14])
@pytest.mark.parametrize("bound", [joins.BROADCAST_ROWS, 0])
def test_packed_rows_of_a_key_come_out_whole(spark, rows, monkeypatch, size, bound):
    """Every row, equal ones too, whatever the number of arrays; the rows of a key are in several small ones."""
    monkeypatch.setattr(joins, "PACKED_ROWS", size)
    dim = spark.createDataFrame([("a", k, k % 5 * 1.0, "x" if k % 2 else None) for k in range(40)] + [("b", 1, 0.5, "y")] * 3
                                + [(None, 1, 0.5, "z")], "k string, n int, v double, t string")
    big = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c"), (5, "a")], "id long, k string")
    arrays = joins.packed(dim, "k", ["v", "t"])
    if size == 2:
        assert arrays.where("k = 'a'").agg(F.max(F.size("_rows"))).first()[0] < 10
    joined = joins.unpacked(joins.lookup_join(big, arrays, "k", "inner", spread=["id"], max_rows=bound))
    assert joined.columns == ["k", "id", "v", "t"]
    order = ["id", "v", "t"]
    assert rows(joined, *order) == rows(big.join(dim, "k").select("k", "id", "v", "t"), *order)
    assert joined.count() == 83


def test_many_equal_rows_are_not_packed(spark, rows, monkeypatch):
    """They would be one array; the join then takes the rows as they are, and the result is whole."""
    monkeypatch.setattr(joins, "PACKED_ROWS", 2)
    side = spark.createDataFrame([("A", 2014, 0.5)] * 50 + [("B", 2014, 1.5)], "unique_id string, cycle int, dwdime double")
    assert joins.packed(side, "unique_id", ["dwdime"]) is None
    texts = spark.createDataFrame([(1, "A", LONG), (2, "B", LONG)], "speech_id long, unique_id string, speech string")
    found = clean.join_scores(texts, side, chars="n")
    assert rows(found, "speech_id") == [(1, 60, "A", 0.5)] * 50 + [(2, 60, "B", 1.5)]


def test_repeats_of_a_speech_are_not_looked_up_one_by_one(spark, monkeypatch):
    sides, real = [], clean.lookup_join
    monkeypatch.setattr(clean, "lookup_join", lambda big, dim, *a, **k: sides.append(dim) or real(big, dim, *a, **k))
    many = spark.range(500).select(F.lit("A").alias("unique_id"), F.col("id").cast("int").alias("cycle"),
                                   (F.col("id") * 0.5).alias("dwdime"))
    texts = spark.createDataFrame([(1, "A", LONG), (2, "B", LONG)], "speech_id long, unique_id string, speech string")
    found = clean.join_scores(texts, many, keep_cycle=True)
    assert found.count() == 500 and found.agg(F.sum("cycle")).first()[0] == 124750
    assert sides[0].count() == 1


def test_present_drops_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, t string")
    assert clean.present(df, "x", "t").collect() == [(1.0, "a")]


def test_missing_keys_match_only_on_request(spark, rows):
    left = speeches(spark).withColumn("unique_id", F.nullif("unique_id", F.lit("SMITH_TX_1")))
    assert clean.join_scores(left, scores(spark), min_length=0).count() == 1
    both = clean.join_scores(left, scores(spark), min_length=0, match_missing=True)
    assert rows(both.select("speech_id", "unique_id", "dime"), "speech_id") == [
        (1, None, -0.9), (2, None, -0.9), (3, "REED_RI_S", -0.2)]


def test_length_counts_characters(spark):
    df = spark.createDataFrame([("😀a",), ("abc",)], "t string")
    assert clean.long_enough(df, "t", 3).count() == 1
    assert clean.long_enough(df, "t", 0).count() == 2


def test_salted_join_equals_plain(spark, rows):
    big = spark.range(500).select("id", F.when(F.col("id") < 200, 0).otherwise(F.col("id") % 7).alias("k"))
    dim = spark.createDataFrame([(0, "a"), (0, "b"), (3, "c"), (None, "d")], "k long, v string")
    for how in ("left", "inner"):
        plain = rows(big.join(dim, "k", how).select("id", "k", "v"), "id", "v")
        assert rows(joins.lookup_join(big, dim, "k", how, max_rows=0).select("id", "k", "v"),
                    "id", "v") == plain
    with pytest.raises(ValueError):
        joins.lookup_join(big, dim, "k", "right")


def test_long_rows_pass_a_hashed_dimension_unsorted(spark, rows, monkeypatch):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", "x" * 50) for i in range(300)], "id long, k string, body string")
    dim = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3)], "k string, v int")
    plan = lambda df: df._jdf.queryExecution().toString()
    for how in ("left", "inner"):
        monkeypatch.setattr(joins, "HASH_BYTES", 2 ** 26)
        hashed = joins.lookup_join(big, dim, "k", how, spread=["id"], max_rows=0)
        monkeypatch.setattr(joins, "HASH_BYTES", 0)
        merged = joins.lookup_join(big, dim, "k", how, spread=["id"], max_rows=0)
        assert "ShuffledHashJoin" in plan(hashed) and "SortMergeJoin" not in plan(hashed)
        assert "SortMergeJoin" in plan(merged)
        wanted = big.join(dim, "k", how).select("id", "k", "v")
        for found in (hashed, merged):
            assert rows(found.select("id", "k", "v"), "id", "v") == rows(wanted, "id", "v")
