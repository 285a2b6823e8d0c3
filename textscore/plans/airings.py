"""Ad airings: filters, buckets, issue flags, keys and scores."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from textscore import settings
from textscore.functions import keys
from textscore.operators.joins import lookup_join
from textscore.operators.pick import first_per_key
from textscore.operators.quantile import above_quantile
from textscore.plans.clean import latest_scores, long_enough, missing_to_null, present, project

AIRING_COLUMNS = ["vidfile", "unique_id", "dime", "party", "race_id", "biweek"]
AD_COLUMNS = ["vidfile", "ad_text", "unique_id", "dime", "party"]


def issue_columns(columns, excluded=settings.NOT_ISSUES):
    """Columns named like issues, less the ones that are not codes."""
    return [c for c in columns if "issue" in c.lower() and c not in excluded]


def flag_issues(df, columns):
    """Positive codes become 1, everything else 0; rows without any 1 go."""
    flags = {c: F.when(F.col(c) > 0, 1).otherwise(0) for c in columns}
    flagged = df.withColumns(flags)
    coded = reduce(add, [F.col(c) for c in columns], F.lit(0))
    return flagged.where(coded > 0)


def not_blank(column):
    c = F.col(column)
    return c.isNotNull() & ~c.rlike(r"(?U)^\s*$")


def time_buckets(df, day=settings.ELECTION_DAY, date="airdate"):
    """Days before the fixed day, and the week and fortnight they fall in."""
    return (df.withColumn("day", keys.days_before(day, date))
            .withColumns({"week": keys.bucket(F.col("day"), 7),
                          "biweek": keys.bucket(F.col("day"), 14)}))


def select_airings(airings, affiliates=settings.AFFILIATES, election=settings.ELECTION,
                   cost_quantile=settings.COST_QUANTILE):
    """General-election airings on major affiliates above the cost quantile.

    The quantile is that of the rows left by the two filters before it.
    """
    kept = missing_to_null(airings).where(
        (F.col("election") == election) & F.col("affiliate").isin(*affiliates))
    return above_quantile(kept, "est_cost", cost_quantile)


def scored_airings(airings, scores, corrections=settings.AD_CORRECTIONS):
    """Every coded airing with its key and the candidate's latest score, NULL if unknown."""
    df = select_airings(airings).withColumns({
        "state": F.col("categorystate"),
        "district": F.when(F.col("senate") == 1, F.lit(settings.SENATE_DISTRICT))
                     .otherwise(F.col("district").cast("string")),
        "year": F.lit(settings.ELECTION_YEAR),
    })
    df = time_buckets(df.withColumn(
        "race_id", keys.race_key("state", "district", F.col("year"))))
    df = df.where(F.col("codingstatus") == settings.CODED)
    df = flag_issues(df, issue_columns(df.columns)).where(not_blank("cand_id"))
    df = keys.correct(df.withColumn("unique_id", keys.ad_key()), corrections)
    side = latest_scores(scores).select("unique_id", F.col("dwdime").alias("dime"))
    return lookup_join(df, side, "unique_id", spread=["vidfile", "airdate", "affiliate", "est_cost"])


def clean_airings(scored):
    """All airings with a score."""
    return present(project(scored, AIRING_COLUMNS), "dime")


def unique_ads(ad_text, scored, order=("airdate", "unique_id", "party"),
               min_length=settings.MIN_AD_LENGTH):
    """One row per transcript, with the first airing of its file in `order`."""
    columns = ["vidfile", "unique_id", "dime", "party"]
    wanted = project(scored, [*columns, *[c.lstrip("-") for c in order]])
    wanted = wanted.select(*dict.fromkeys(wanted.columns))
    first = project(first_per_key(wanted, "vidfile", list(order)), columns)
    ads = project(ad_text.join(first, "vidfile", "left"), AD_COLUMNS)
    return long_enough(present(ads, "ad_text", "dime"), "ad_text", min_length)
