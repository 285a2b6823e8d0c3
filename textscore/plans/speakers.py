"""One entity per speaker: first scores, and all tokens in speech order.

A speaker's tokens are kept as rows, never as one array: a third of all speeches may
belong to one speaker.
"""

from pyspark.sql import functions as F

from textscore.operators.ordering import Ordered
from textscore.operators.pick import first_value
from textscore.plans.tokens import with_row_id

SCORE_COLUMNS = ("gen_vote_pct", "gwinner", "dime")
CHUNK = 50_000


def speaker_scores(df, order=("speech_id",), key="unique_id", columns=SCORE_COLUMNS):
    """First non-NULL value of each column per speaker; speakers without a key go."""
    firsts = [first_value(c, list(order)).alias(c) for c in columns if c in df.columns]
    counted = [F.count("*").alias("speeches"), F.sum(F.size("tokens")).alias("token_count")]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*firsts, *counted)


def _placed(df, order, key, tokens):
    """(key, _row, _offset, tokens): each speech with the place of its first token in the speaker's list.

    Speeches are ordered by (order, row number). The row number is written down with the
    speeches, so rows that share an order value, as a kept fan-out of scores makes them, are told
    apart. Only the counts are sorted; a hot speaker's speeches spread like all others.
    """
    speeches = with_row_id(df.where(F.col(key).isNotNull()).select(key, *order, tokens))
    size = F.col("_size")
    count = F.greatest(F.size(F.coalesce(tokens, F.array())), F.lit(0)).cast("bigint")
    ordered = Ordered(speeches.select(key, *order, "_row", count.alias("_size")),
                      [key, *order, "_row"], "sizes")
    ordered.running("_upto", size).previous("_before", F.col(key))
    start = F.when(F.col("_before").isNull() | (F.col("_before") != F.col(key)),
                   F.col("_upto") - size)
    ordered.running("_start", start, "max")
    offsets = ordered.result().where(size > 0).select(
        "_row", (F.col("_upto") - size - F.col("_start")).alias("_offset"))
    return speeches.select(key, "_row", tokens).join(offsets, "_row")


def speaker_tokens(df, order=("speech_id",), key="unique_id", tokens="tokens"):
    """Each speaker's concatenated token list as rows (key, pos, term)."""
    placed = _placed(df, list(order), key, tokens)
    return (placed.select(key, "_offset", F.posexplode(tokens).alias("_i", "term"))
            .select(key, (F.col("_offset") + F.col("_i")).alias("pos"), "term"))


def speaker_chunks(df, order=("speech_id",), key="unique_id", tokens="tokens", size=CHUNK):
    """The list in arrays of `size` tokens, the last one shorter; chunk after chunk it is the whole list.

    Arrays are cut at the borders of the chunks, so pieces move, not tokens.
    """
    placed = _placed(df, list(order), key, tokens)
    last = F.col("_offset") + F.size(tokens) - 1
    chunks = F.sequence(F.floor(F.col("_offset") / F.lit(size)), F.floor(last / F.lit(size)))
    begin = F.greatest(F.col("chunk") * F.lit(size) - F.col("_offset"), F.lit(0)).cast("int")
    end = F.least((F.col("chunk") + 1) * F.lit(size) - F.col("_offset"), F.size(tokens)).cast("int")
    pieces = (placed.withColumn("chunk", F.explode(chunks))
              .select(key, "chunk", (F.col("_offset") + begin).alias("pos"),
                      F.slice(tokens, begin + 1, end - begin).alias("piece")))
    sorted_pieces = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return pieces.groupBy(key, "chunk").agg(
        F.flatten(F.transform(sorted_pieces, lambda p: p["piece"])).alias("tokens"))
