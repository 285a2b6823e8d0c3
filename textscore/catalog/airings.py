"""The airings branch on line items and orders."""

from pyspark.sql import functions as F

from textscore.catalog.common import table
from textscore.functions import keys
from textscore.plans import airings, clean


def ad_key(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("cand_id"), F.col("o_orderstatus").alias("state"),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("district"))
    return orders.select("o_orderkey", keys.ad_key().alias("unique_id"))


def airing_percentile_filter(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("election"),
        F.col("l_returnflag").alias("affiliate"), F.col("l_extendedprice").alias("est_cost"))
    return airings.select_airings(lines, affiliates=("A", "R"), election="O").select(
        "l_orderkey", "l_linenumber", "est_cost")


def airing_time_buckets(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("airdate"),
        F.when(F.col("l_linestatus") == "O", F.lit("60"))
        .otherwise(F.col("l_suppkey").cast("string")).alias("district"),
        F.col("l_returnflag").alias("state"))
    bucketed = airings.time_buckets(lines, "1998-11-03")
    return bucketed.select(
        "l_orderkey", "l_linenumber", "day", "week", "biweek",
        keys.race_key("state", "district", F.lit("1998")).alias("race_id"))


def issue_binarise(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_discount").alias("issue10"),
        (F.col("l_tax") - 0.04).alias("Issue11"),
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity") - 25).alias("issue12"),
        F.col("l_quantity").alias("issue97"))
    return airings.flag_issues(lines, airings.issue_columns(lines.columns)).drop("issue97")


def blank_filter(spark, sf):
    events = table(spark, sf, "events").withColumn(
        "cand_id", F.when(F.col("event_type") == "error", F.lit(" \t "))
        .when(F.col("event_type") != "click", F.col("props")))
    return events.where(airings.not_blank("cand_id")).select("event_id", "cand_id")


def latest_per_key(spark, sf):
    scores = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("unique_id"), F.year("o_orderdate").alias("cycle"),
        F.col("o_totalprice").alias("dwdime"))
    return clean.latest_scores(scores)


def first_per_key(spark, sf):
    ads = table(spark, sf, "part").select(
        F.col("p_partkey").alias("vidfile"), F.col("p_name").alias("ad_text"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("vidfile"), F.col("l_suppkey").cast("string").alias("unique_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice")).alias("dime"),
        F.col("l_returnflag").alias("party"), F.col("l_shipdate").alias("airdate"),
        "l_orderkey", "l_linenumber")
    return airings.unique_ads(ads, lines, ("airdate", "l_orderkey", "l_linenumber", "unique_id", "dime"))


def airings_end_to_end(spark, sf):
    """All steps in their order: filters, quantile, buckets, flags, key, latest score."""
    lines = table(spark, sf, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("vidfile"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("_x")).alias("cand_id"),
        F.col("l_returnflag").alias("categorystate"),
        F.when(F.col("l_linestatus") == "O", "GENERAL").otherwise("PRIMARY").alias("election"),
        F.element_at(F.array(F.lit("ABC"), F.lit("CBS"), F.lit("PBS")),
                     F.when(F.col("l_linenumber") > 3, 3).otherwise(F.col("l_linenumber"))
                     ).alias("affiliate"),
        F.col("l_extendedprice").alias("est_cost"),
        F.when(F.col("l_quantity") > 45, 1).otherwise(0).alias("senate"),
        F.lpad(F.col("l_linenumber").cast("string"), 3, "0").alias("district"),
        F.col("l_shipdate").alias("airdate"),
        F.when(F.col("l_tax") > 0.02, 1).otherwise(0).alias("codingstatus"),
        F.lit("X").alias("party"), F.col("l_discount").alias("issue10"))
    scores = table(spark, sf, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string"), F.lit("_"), "l_returnflag",
                 F.lit("_"), F.when(F.col("l_quantity") > 45, F.lit("60")).otherwise(
                     F.col("l_linenumber").cast("string"))).alias("unique_id"),
        F.year("l_shipdate").alias("cycle"),
        F.when(F.col("l_discount") < 0.09, F.col("l_extendedprice")).alias("dwdime"))
    return airings.clean_airings(airings.scored_airings(lines, scores))


QUERIES = {f.__name__: f for f in (
    ad_key, airing_percentile_filter, airing_time_buckets, issue_binarise, blank_filter,
    latest_per_key, first_per_key, airings_end_to_end)}

ORACLE = {
    "ad_key": r"""
        SELECT o_orderkey,
               upper(replace(string_split_regex(o_orderpriority, '[_,\- ]')[1], '''', '')) || '_'
                 || o_orderstatus || '_'
                 || coalesce(nullif(regexp_replace(
                        lpad(CAST(o_custkey AS VARCHAR), 6, '0'), '^0+', ''), ''), '0') AS unique_id
        FROM orders""",
    "airing_percentile_filter": """
        WITH kept AS (SELECT * FROM lineitem
                      WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'R'))
        SELECT l_orderkey, l_linenumber, l_extendedprice AS est_cost FROM kept
        WHERE l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.05) FROM kept)""",
    "airing_time_buckets": """
        WITH days AS (SELECT *, date_diff('day', CAST(l_shipdate AS DATE), DATE '1998-11-03') AS day
                      FROM lineitem)
        SELECT l_orderkey, l_linenumber, CAST(day AS BIGINT) AS day,
               CAST(floor(day / 7.0::DOUBLE) AS BIGINT) AS week,
               CAST(floor(day / 14.0::DOUBLE) AS BIGINT) AS biweek,
               l_returnflag || CASE WHEN l_linestatus = 'O' THEN '60'
                                    ELSE CAST(l_suppkey AS VARCHAR) END || '-1998' AS race_id
        FROM days""",
    "issue_binarise": """
        WITH flags AS (
            SELECT l_orderkey, l_linenumber,
                   CASE WHEN l_discount > 0 THEN 1 ELSE 0 END AS issue10,
                   CASE WHEN l_tax - 0.04::DOUBLE > 0 THEN 1 ELSE 0 END AS "Issue11",
                   CASE WHEN l_returnflag = 'A' AND l_quantity > 25 THEN 1 ELSE 0 END AS issue12
            FROM lineitem)
        SELECT * FROM flags WHERE issue10 + "Issue11" + issue12 > 0""",
    "blank_filter": """
        SELECT event_id, props AS cand_id FROM events
        WHERE event_type NOT IN ('error', 'click') AND props IS NOT NULL""",
    "latest_per_key": """
        SELECT unique_id, cycle, dwdime FROM (
            SELECT o_custkey AS unique_id, CAST(year(o_orderdate) AS INTEGER) AS cycle,
                   o_totalprice AS dwdime,
                   row_number() OVER (PARTITION BY o_custkey
                                      ORDER BY year(o_orderdate) DESC, o_totalprice) AS rn
            FROM orders) WHERE rn = 1""",
    "first_per_key": """
        WITH firsts AS (
            SELECT *, row_number() OVER (PARTITION BY l_partkey
                ORDER BY l_shipdate, l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR),
                         CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END NULLS LAST) AS rn
            FROM lineitem)
        SELECT p_partkey AS vidfile, p_name AS ad_text, CAST(l_suppkey AS VARCHAR) AS unique_id,
               l_extendedprice AS dime, l_returnflag AS party
        FROM part JOIN firsts ON p_partkey = l_partkey AND rn = 1
        WHERE l_returnflag <> 'N' AND length(p_name) >= 10""",
    "airings_end_to_end": """
        WITH kept AS (SELECT * FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber <= 2),
        costly AS (
            SELECT *, date_diff('day', CAST(l_shipdate AS DATE), DATE '2016-11-08') AS day,
                   CASE WHEN l_quantity > 45 THEN '60' ELSE CAST(l_linenumber AS VARCHAR)
                   END AS seat,
                   CASE WHEN l_quantity > 45 THEN '60'
                        ELSE lpad(CAST(l_linenumber AS VARCHAR), 3, '0') END AS district
            FROM kept
            WHERE l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.05) FROM kept)),
        coded AS (SELECT *, 'S' || l_suppkey || '_' || l_returnflag || '_' || seat AS unique_id
                  FROM costly WHERE l_tax > 0.02 AND l_discount > 0),
        scores AS (
            SELECT 'S' || l_suppkey || '_' || l_returnflag || '_'
                     || CASE WHEN l_quantity > 45 THEN '60' ELSE CAST(l_linenumber AS VARCHAR)
                        END AS unique_id,
                   CASE WHEN l_discount < 0.09 THEN l_extendedprice END AS dime,
                   year(l_shipdate) AS cycle FROM lineitem),
        latest AS (SELECT *, row_number() OVER (PARTITION BY unique_id
                       ORDER BY cycle DESC, dime NULLS LAST) AS rn FROM scores)
        SELECT l_orderkey || '-' || l_linenumber AS vidfile, coded.unique_id, dime, 'X' AS party,
               l_returnflag || district || '-2016' AS race_id,
               CAST(floor(day / 14.0::DOUBLE) AS BIGINT) AS biweek
        FROM coded JOIN latest ON coded.unique_id = latest.unique_id AND rn = 1
        WHERE dime IS NOT NULL""",
}
