"""Scores, speeches and their joins on stand-in tables."""

import uuid

from pyspark.sql import functions as F

from textscore.catalog.common import table
from textscore.functions import keys
from textscore.plans import clean, report
from textscore.schemas import SPEECHES
from textscore.sources import readers, writers
from textscore.sources.work import work_dir

SEATS = ("Brand#1", "Brand#12", "Brand#23")


def score_filter_key(spark, sf):
    part = table(spark, sf, "part")
    place = F.when(F.col("p_brand") == "Brand#1", F.col("p_type")).otherwise(
        F.concat_ws("_", "p_type", "p_brand", "p_size"))
    scores = part.select("p_partkey", F.col("p_size").alias("cycle"), F.col("p_brand").alias("seat"),
                         F.col("p_name").alias("lname"), place.alias("distcyc"))
    return clean.clean_scores(scores, (10, 40), SEATS).select(
        "p_partkey", "cycle", "seat", "unique_id")


def speech_speaker_right_join(spark, sf):
    lastname = (F.when(F.col("c_mktsegment") == "BUILDING", F.lit(""))
                .when(F.col("c_mktsegment") != "MACHINERY", F.concat("c_name", F.lit(" Jr"))))
    speakers = table(spark, sf, "customer").select(
        F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).alias("speech_id"), F.col("c_custkey").alias("speakerid"),
        lastname.alias("lastname"), F.col("c_name").alias("firstname"),
        F.nullif("c_mktsegment", F.lit("HOUSEHOLD")).alias("state"),
        F.nullif("c_nationkey", F.lit(5)).cast("double").alias("district"))
    speeches = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("speech_id"), F.col("o_orderpriority").alias("speech"))
    return clean.keyed_speeches(speakers, speeches, {}).select("speech_id", "speech", "unique_id")


SPEAKER_KEY_SQL = """
    SELECT o_custkey AS speech_id, o_orderpriority AS speech,
           upper(split_part(c_name || ' Jr', ' ', 1)) || '_'
             || upper(coalesce(nullif(c_mktsegment, 'HOUSEHOLD'), 'nan')) || '_'
             || coalesce(CAST(nullif(c_nationkey, 5) AS VARCHAR), 'S') AS unique_id
    FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 0
    WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"""


def _speeches(spark, sf, key):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("speech_id"), F.col("text").alias("speech"),
        key.alias("unique_id"), F.col("lang").alias("state"))


def _scores(spark, sf, key=None):
    key = F.concat(F.lit("src"), F.col("s_nationkey").cast("string")) if key is None else key
    return table(spark, sf, "supplier").select(
        key.alias("unique_id"), F.col("s_suppkey").cast("int").alias("cycle"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("dwdime"),
        F.lit("TX").alias("state"))


def score_left_join_fanout(spark, sf):
    joined = clean.join_scores(_speeches(spark, sf, F.col("source")), _scores(spark, sf), chars="chars")
    return joined.select("speech_id", "unique_id", "state", "dime", "chars")


def score_join_latest(spark, sf):
    joined = clean.join_scores(_speeches(spark, sf, F.col("source")), _scores(spark, sf),
                               dedup="latest")
    return joined.select("speech_id", "unique_id", "dime")


def score_join_missing_keys(spark, sf):
    key = F.nullif(F.concat(F.lit("src"), F.col("s_nationkey").cast("string")), F.lit("src3"))
    joined = clean.join_scores(_speeches(spark, sf, F.nullif("source", F.lit("src3"))),
                               _scores(spark, sf, key), min_length=0, match_missing=True)
    return joined.select("speech_id", "unique_id", "dime")


def key_corrections(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("unique_id"))
    return keys.correct(customers, {"BUILDING": "MACHINERY", "MACHINERY": "HOUSEHOLD"})


def cleaning_summary(spark, sf):
    joined = clean.join_scores(_speeches(spark, sf, F.col("source")), _scores(spark, sf))
    out = report.summary(joined, "unique_id")
    return out.withColumn("mean_score", F.round("mean_score", 6))


def csv_read_back(spark, sf):
    customers = table(spark, sf, "customer")
    path = f"{work_dir(spark)}/customer-csv-{uuid.uuid4().hex}"
    writers.export_csv(customers, path)
    return readers.read_csv(spark, path, customers.schema)


def delimited_read_back(spark, sf):
    path = f"{work_dir(spark)}/orders-psv-{uuid.uuid4().hex}"
    text = F.when(F.col("o_orderstatus") == "P", F.concat("o_orderpriority", F.lit("|x"))).otherwise(
        F.col("o_orderpriority"))
    (table(spark, sf, "orders").select(F.col("o_orderkey").alias("speech_id"), text.alias("speech"))
     .write.option("header", True).option("sep", "|").option("quote", "\0").csv(path))
    return readers.read_delimited(spark, path, SPEECHES, too_long="skip")


QUERIES = {f.__name__: f for f in (
    score_filter_key, speech_speaker_right_join, score_left_join_fanout, score_join_latest,
    score_join_missing_keys, key_corrections, cleaning_summary, csv_read_back,
    delimited_read_back)}

SCORES_CTE = """
    scores AS (SELECT 'src' || s_nationkey AS unique_id, s_suppkey AS cycle,
                      CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS dwdime FROM supplier)"""

ORACLE = {
    "score_filter_key": """
        SELECT p_partkey, p_size AS cycle, p_brand AS seat,
               CASE WHEN p_brand <> 'Brand#1'
                    THEN upper(split_part(p_name, ' ', 1)) || '_' || p_brand || '_' || p_size
               END AS unique_id
        FROM part WHERE p_size BETWEEN 10 AND 40
          AND p_brand IN ('Brand#1', 'Brand#12', 'Brand#23')""",
    "speech_speaker_right_join": SPEAKER_KEY_SQL,
    "score_left_join_fanout": f"""
        WITH {SCORES_CTE}
        SELECT doc_id AS speech_id, source AS unique_id, lang AS state, dwdime AS dime,
               CAST(length(text) AS INTEGER) AS chars
        FROM documents JOIN scores ON source = unique_id
        WHERE dwdime IS NOT NULL AND length(text) >= 50""",
    "score_join_latest": f"""
        WITH {SCORES_CTE},
        latest AS (SELECT *, row_number() OVER (
                       PARTITION BY unique_id ORDER BY cycle DESC, dwdime NULLS LAST) AS rn
                   FROM scores)
        SELECT doc_id AS speech_id, source AS unique_id, dwdime AS dime
        FROM documents JOIN latest ON source = unique_id AND rn = 1
        WHERE dwdime IS NOT NULL AND length(text) >= 50""",
    "score_join_missing_keys": f"""
        WITH {SCORES_CTE}
        SELECT doc_id AS speech_id, nullif(source, 'src3') AS unique_id, dwdime AS dime
        FROM documents JOIN scores
          ON nullif(source, 'src3') IS NOT DISTINCT FROM nullif(unique_id, 'src3')
        WHERE dwdime IS NOT NULL""",
    "key_corrections": """
        SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'MACHINERY'
                          WHEN 'MACHINERY' THEN 'HOUSEHOLD' ELSE c_mktsegment END AS unique_id
        FROM customer""",
    "cleaning_summary": f"""
        WITH {SCORES_CTE}
        SELECT count(*) AS rows, count(DISTINCT unique_id) AS entities,
               round(avg(dwdime), 6) AS mean_score
        FROM documents JOIN scores ON source = unique_id
        WHERE dwdime IS NOT NULL AND length(text) >= 50""",
    "csv_read_back": "SELECT * FROM customer",
    "delimited_read_back": """
        SELECT o_orderkey AS speech_id, o_orderpriority AS speech
        FROM orders WHERE o_orderstatus <> 'P'""",
}
