from datetime import date

import pytest

from textscore.operators.pick import first_per_key
from textscore.operators.quantile import above_quantile, exact_quantiles
from textscore.plans import airings

COLUMNS = ("vidfile string, categorystate string, election string, affiliate string, "
           "est_cost double, senate int, district string, airdate date, codingstatus int, "
           "cand_id string, party string, issue10 int, Issue11 int, issue int, issue97 int")


def airing(vidfile="v1", cost=100.0, **changes):
    row = dict(vidfile=vidfile, categorystate="TX", election="GENERAL", affiliate="ABC",
               est_cost=cost, senate=0, district="016", airdate=date(2016, 10, 20),
               codingstatus=1, cand_id="O'Rourke_Beto", party="D", issue10=3, Issue11=None,
               issue=1, issue97=1)
    return tuple({**row, **changes}.values())


def scores(spark):
    return spark.createDataFrame([
        ("OROURKE_TX_16", 2014, 0.1), ("OROURKE_TX_16", 2016, 0.3), ("OROURKE_TX_60", 2016, 0.6),
        ("YOUNG_IA_3", 2016, 0.5)], "unique_id string, cycle int, dwdime double")


def test_quantile_cut(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,), (50.0,), (None,)], "c double")
    assert exact_quantiles(df, "c", [0.05, 0.5]).first()[:] == (12.0, 30.0)
    assert sorted(r[0] for r in above_quantile(df, "c", 0.05).collect()) == [20, 30, 40, 50]
    ties = spark.createDataFrame([(5.0,), (5.0,), (5.0,), (9.0,)], "c double")
    assert [r[0] for r in above_quantile(ties, "c", 0.05).collect()] == [9.0]
    assert above_quantile(df.where("c < 0"), "c", 0.05).count() == 0


def test_quantiles_match_numpy(spark):
    import numpy as np

    values = np.random.default_rng(1).lognormal(size=3000).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "c double")
    shares = [0.0, 0.05, 0.333, 0.9, 1.0]
    np.testing.assert_allclose(list(exact_quantiles(df, "c", shares).first()),
                               np.quantile(values, shares), rtol=1e-12)


def test_issue_columns_and_flags(spark, rows):
    df = spark.createDataFrame([(1, 3, None), (2, 0, None), (3, -1, 0), (4, 0, 9)],
                               "id int, issue10 int, Issue11 int")
    assert airings.issue_columns([*df.columns, "issue", "issue97_txt"]) == ["issue10", "Issue11"]
    assert rows(airings.flag_issues(df, ["issue10", "Issue11"]), "id") == [(1, 1, 0), (4, 0, 1)]


def test_not_blank(spark):
    df = spark.createDataFrame([("a",), ("",), (" \t ",), (None,), (" b ",)], "c string")
    assert [r[0] for r in df.where(airings.not_blank("c")).collect()] == ["a", " b "]


def test_end_to_end(spark, rows):
    table = spark.createDataFrame([
        airing("v1"), airing("v2", senate=1), airing("v3", cand_id="David_x", categorystate="IA", district="03"),
        airing("low", 1.0), airing("primary", 50.0, election="PRIMARY"), airing("cable", affiliate="ESPN"),
        airing("uncoded", codingstatus=0), airing("noissue", issue10=0), airing("blank", cand_id="  "),
        airing("unscored", cand_id="Nobody"), airing("free", None)], COLUMNS)
    scored = airings.scored_airings(table, scores(spark))
    clean = airings.clean_airings(scored)
    assert clean.columns == airings.AIRING_COLUMNS
    assert rows(clean, "vidfile") == [
        ("v1", "OROURKE_TX_16", 0.3, "D", "TX016-2016", 1),
        ("v2", "OROURKE_TX_60", 0.6, "D", "TX60-2016", 1),
        ("v3", "YOUNG_IA_3", 0.5, "D", "IA03-2016", 1)]
    texts = spark.createDataFrame([("v1", "a long enough text"), ("v2", "short"),
                                   ("unscored", "a long enough text"), ("x", "never aired text")],
                                  "vidfile string, ad_text string")
    assert rows(airings.unique_ads(texts, scored)) == [
        ("v1", "a long enough text", "OROURKE_TX_16", 0.3, "D")]


def test_first_airing_decides_even_without_score(spark):
    scored = spark.createDataFrame([
        ("v", "A", None, "D", date(2016, 1, 1)), ("v", "B", 0.5, "D", date(2016, 1, 2))],
        "vidfile string, unique_id string, dime double, party string, airdate date")
    texts = spark.createDataFrame([("v", "a long enough text")], "vidfile string, ad_text string")
    assert airings.unique_ads(texts, scored).count() == 0


def test_first_per_key_orders(spark, rows):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5.0), ("a", 2, None), ("b", None, 1.0),
                                (None, 3, 3.0), (None, 4, 4.0)], "k string, n int, x double")
    assert rows(first_per_key(df, "k", ["-n", "x"]), "k") == [
        (None, 4, 4.0), ("a", 2, 5.0), ("b", None, 1.0)]
