from datetime import date, datetime

from pyspark.sql import functions as F

from textscore import settings
from textscore.functions import keys


def test_score_key(spark):
    df = spark.createDataFrame([
        ("Van Hollen", "2014_MD_8"), ("  ros", "2016_FL_27"), ("   ", "2014_AL_5"),
        ("Smith", "2014"), (None, "2014_AL_5"), ("O Neil", "2014_A_B_C")],
        "lname string, distcyc string")
    assert [r[0] for r in df.select(keys.score_key()).collect()] == [
        "VAN_MD_8", "ROS_FL_27", None, None, None, "O_A_B_C"]


def test_speaker_key_and_corrections(spark):
    df = spark.createDataFrame([
        ("NORTON", "DC", 0.0), ("Van Hollen", "MD", 8.0), ("Reed", "RI", None),
        ("Reed", None, float("nan")), ("Ros-Lehtinen", "fl", 27.9)],
        "lastname string, state string, district double")
    keyed = keys.correct(df.withColumn("unique_id", keys.speaker_key()),
                         settings.SPEAKER_CORRECTIONS)
    assert [r["unique_id"] for r in keyed.collect()] == [
        "NORTON_DC_1", "VANHOLLEN_MD_8", "REED_RI_S", "REED_NAN_S", "ROS_FL_27"]


def test_speaker_key_takes_text_districts(spark):
    df = spark.createDataFrame([("A", "TX", "16"), ("A", "TX", "16.0"), ("A", "TX", "x")],
                               "lastname string, state string, district string")
    assert [r[0] for r in df.select(keys.speaker_key()).collect()] == [
        "A_TX_16", "A_TX_16", "A_TX_S"]


def test_ad_key(spark):
    df = spark.createDataFrame([
        ("O'Rourke_Beto", "TX", "016"), ("VAN HOLLEN", "MD", "60"), ("-X", "AK", "000"),
        ("smith,j", None, None)], "cand_id string, state string, district string")
    assert [r[0] for r in df.select(keys.ad_key()).collect()] == [
        "OROURKE_TX_16", "VAN_MD_60", "_AK_0", "SMITH_nan_nan"]


def test_corrections_are_one_pass(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",)], "unique_id string")
    assert [r[0] for r in keys.correct(df, {"A": "B", "B": "C"}).collect()] == ["B", "C", "C"]


def test_time_buckets_floor(spark):
    from textscore.plans.airings import time_buckets

    df = spark.createDataFrame(
        [(date(2016, 10, 20),), (date(2016, 11, 8),), (date(2016, 11, 11),), (None,)], "airdate date")
    assert [tuple(r)[1:] for r in time_buckets(df).collect()] == [
        (19, 2, 1), (0, 0, 0), (-3, -1, -1), (None, None, None)]
    timed = spark.createDataFrame([(datetime(2016, 11, 8, 13),), (datetime(2016, 11, 7, 13),)],
                                  "airdate timestamp")
    assert [r["day"] for r in time_buckets(timed).collect()] == [-1, 0]


def test_race_key_spells_missing_district(spark):
    df = spark.createDataFrame([("TX", "16"), ("TX", None), (None, "16")], "state string, district string")
    got = [r[0] for r in df.select(keys.race_key("state", "district", F.lit("2016"))).collect()]
    assert got == ["TX16-2016", "TXnan-2016", None]
