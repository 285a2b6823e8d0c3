"""Scores, keyed speeches and their join."""

from pyspark.sql import functions as F

from textscore import settings
from textscore.functions import keys
from textscore.operators.joins import lookup_join, null_safe_key, packed, unpacked
from textscore.operators.pick import first_per_key

SPEECH_COLUMNS = ["speakerid", "speech_id", "speech", "unique_id", "lastname", "firstname",
                  "state", "district", "dime", "gen_vote_pct", "gwinner"]


def project(df, columns):
    """The listed columns that exist, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])


def long_enough(df, column, minimum):
    """At least `minimum` characters; a minimum of 0 or less switches the test off."""
    return df.where(F.length(column) >= minimum) if minimum > 0 else df


def present(df, *columns):
    """Rows that have all these columns.

    Spelled out as `is not null`, so that Catalyst turns the outer join before it into an
    inner one and drops missing keys ahead of the shuffle.
    """
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    for c in columns:
        df = df.where(F.col(c).isNotNull())
        if c in floats:
            df = df.where(~F.isnan(c))
    return df


def missing_to_null(df):
    """Turn NaN into NULL in every floating column: there is one kind of missing value."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*[
        F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c)
        if c in floats else F.col(f"`{c}`") for c in df.columns])


def clean_scores(scores, cycles=settings.CYCLES, seats=settings.SEATS):
    """Scored candidates of the period and offices asked for, with their key."""
    kept = scores.where(F.col("cycle").between(*cycles) & F.col("seat").isin(*seats))
    kept = missing_to_null(kept).withColumnsRenamed({"gen.vote.pct": "gen_vote_pct"})
    return kept.withColumn("unique_id", keys.score_key())


def keyed_speeches(speakers, speeches, corrections=settings.SPEAKER_CORRECTIONS):
    """Speeches with a named speaker, and the speaker's key.

    Written as the right join it is; the name filter lets Catalyst make it an inner one.
    """
    joined = speakers.join(speeches, "speech_id", "right").select(
        "speakerid", "speech_id", "lastname", "firstname", "speech", "state", "district")
    named = joined.where(F.col("lastname").isNotNull() & (F.col("lastname") != ""))
    return keys.correct(named.withColumn("unique_id", keys.speaker_key()), corrections)


def latest_scores(scores):
    """One score row per key: the latest cycle, then the lowest score."""
    return first_per_key(scores, "unique_id", ["-cycle", "dwdime"])


def score_side(scores, dedup=None):
    scores = latest_scores(scores) if dedup == "latest" else scores
    return project(scores, ["unique_id", "cycle", "dwdime", "gen_vote_pct", "gwinner"])


def join_scores(speeches, scores, min_length=settings.MIN_SPEECH_LENGTH, dedup=None,
                match_missing=False, keep_cycle=False, chars=None):
    """Scored speeches. A key with several score rows repeats the speech (`dedup=None`).

    `match_missing` lets a missing key match a missing key; by default it matches nothing.
    `keep_cycle` keeps the score row's cycle, which orders the repeats of a speech.
    `chars` names a column for the number of characters, which then takes the text's place. They are counted here, once
    a speech: the join may repeat a speech thousands of times, and Spark would count, and move the text, for each repeat.
    """
    speeches = long_enough(present(speeches, "speech"), "speech", min_length)
    if chars:
        speeches = speeches.withColumn(chars, F.length("speech")).drop("speech")
    side, key = present(score_side(scores, dedup), "dwdime"), "unique_id"
    if match_missing:
        speeches, side, key = null_safe_key(speeches, key), null_safe_key(side, key).drop(key), "_match"
    columns = [c for c in side.columns if c != key and (keep_cycle or c != "cycle")]
    arrays = packed(side, key, columns) if dedup is None else None
    joined = lookup_join(speeches, side if arrays is None else arrays, key, "inner", spread=["speech_id"])
    if arrays is not None:
        joined = unpacked(joined)
    joined = joined.withColumnsRenamed({"dwdime": "dime"})
    columns = [chars if chars and c == "speech" else c for c in SPEECH_COLUMNS] + (["cycle"] if keep_cycle else [])
    return project(joined, columns)
