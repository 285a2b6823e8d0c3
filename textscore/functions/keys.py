"""Key and bucket expressions for scores, speakers and ads."""

from pyspark.sql import functions as F


def first_word(c):
    """First run of non-blanks, NULL if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?U)(\S+)", 1), F.lit(""))


def score_key(lname="lname", distcyc="distcyc"):
    """FIRSTWORD + `_` + what follows the first `_`; NULL if either part is missing."""
    place = F.get(F.split(F.col(distcyc), "_", 2), F.lit(1))
    return F.concat(F.upper(first_word(F.col(lname))), F.lit("_"), place)


def text_or_nan(c):
    """A missing value spelled out as text, the way it enters the keys."""
    return F.coalesce(c.cast("string"), F.lit("nan"))


def speaker_key(lastname="lastname", state="state", district="district"):
    """FIRSTWORD_STATE_DISTRICT; a missing district (a senator) reads `S`."""
    number = F.nullif(F.col(district).try_cast("double"), F.lit(float("nan")))
    return F.concat(
        F.upper(first_word(F.col(lastname))), F.lit("_"),
        F.upper(text_or_nan(F.col(state))), F.lit("_"),
        F.coalesce(number.try_cast("bigint").cast("string"), F.lit("S")),
    )


def ad_key(cand_id="cand_id", state="state", district="district"):
    """LASTNAME_STATE_DISTRICT from the candidate code, district without leading zeros."""
    name = F.get(F.split(F.col(cand_id), r"[_,\- ]"), F.lit(0))
    seat = F.regexp_replace(text_or_nan(F.col(district)), "^0+", "")
    return F.concat(
        F.upper(F.replace(name, F.lit("'"), F.lit(""))), F.lit("_"),
        text_or_nan(F.col(state)), F.lit("_"),
        F.coalesce(F.nullif(seat, F.lit("")), F.lit("0")),
    )


def race_key(state, district, year):
    return F.concat(F.col(state), text_or_nan(F.col(district)), F.lit("-"), year)


def correct(df, mapping, column="unique_id"):
    """Replace whole values in one pass; a replaced value is not looked up again."""
    return df.replace(mapping, subset=[column]) if mapping else df


def days_before(day, date):
    """Whole days from `date` to the fixed `day`; a time of day floors the difference."""
    midnight = F.to_date(F.col(date))
    started = F.col(date).cast("timestamp") > midnight.cast("timestamp")
    days = F.datediff(F.lit(day).cast("date"), midnight) - F.when(started, 1).otherwise(0)
    return days.cast("bigint")


def bucket(c, width):
    """Floor division; stays correct for negative numbers."""
    return F.floor(c / F.lit(float(width)))
