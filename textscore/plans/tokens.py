"""Tokenised tables, long form, stopword tables and lemmas."""

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, functions as F

from textscore import settings
from textscore.functions import text
from textscore.operators.joins import has_at_most, likely_in, lookup_join
from textscore.sources.work import materialise


def tokenise(df, column, out="tokens", stopwords=None, remove_stopwords=settings.REMOVE_STOPWORDS,
             lowercase=settings.LOWERCASE):
    """Add the token array of `column` and its length.

    `stopwords` is a short list, which becomes part of the expression, or a table of any length.
    """
    if not remove_stopwords:
        stopwords = ()
    elif stopwords is None:
        stopwords = text.default_stopwords()
    table = stopwords if isinstance(stopwords, DataFrame) else None
    cut = df.withColumn(out, text.tokens(F.col(column), stopwords if table is None else (), lowercase))
    if table is not None:
        cut = drop_words(cut, table, out)
    return cut.withColumn("token_count", F.size(out))


STOPWORD_ROWS = 2_000_000


def drop_words(df, words, column="tokens"):
    """Token arrays without the words of a table (its first column), whatever the case.

    A table within `STOPWORD_ROWS` rows and the byte bound of joins goes to every node, and arrays are cut in place, in
    Arrow batches. A larger one is joined with the tokens in the long form; a frequent token is spread by row and position.
    NULL arrays stay NULL; blank and repeated words count for nothing.
    """
    form = F.lower(F.trim(F.col(f"`{words.columns[0]}`")))
    words = words.select(form.alias("form")).where("form <> ''").distinct()
    if has_at_most(words, STOPWORD_ROWS):
        shared = df.sparkSession.sparkContext.broadcast(words.toArrow()["form"].combine_chunks())

        @F.arrow_udf("array<string>")
        def keep(tokens: pa.Array, forms: pa.Array) -> pa.Array:
            return cut_lists(tokens, ~np.asarray(pa.compute.is_in(forms.flatten(), value_set=shared.value)))

        return df.withColumn(column, keep(F.col(column), F.transform(column, F.lower)))
    numbered = with_row_id(df)
    listed = token_rows(numbered.select("_row", column), ["_row"], column).withColumn("form", F.lower("token"))
    kept = (lookup_join(listed, words.withColumn("_stop", F.lit(True)), "form", spread=["_row", "pos"])
            .where("_stop is null"))
    arrays = token_arrays(kept, ["_row"], "token", "_kept")
    nothing = F.when(F.col(column).isNotNull(), F.array().cast("array<string>"))
    return (numbered.join(arrays, "_row", "left")
            .withColumn(column, F.coalesce("_kept", nothing)).select(*df.columns))


def cut_lists(lists, keep):
    """An Arrow list column with only the elements that `keep` marks, one flag for each element in order."""
    offsets = np.concatenate([[0], np.cumsum(keep)])[list_offsets(lists)].astype(np.int32)
    values = lists.flatten().filter(pa.array(keep, pa.bool_()))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=lists.is_null())


def tokenise_with(df, column, make_tokeniser, out="tokens"):
    """The same with a user's tokeniser, for a statistical language model.

    `make_tokeniser()` runs once per task and returns a function from a list of texts to a
    list of token lists; texts arrive in Arrow batches.
    """
    from collections.abc import Iterator

    import pandas as pd

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokeniser = make_tokeniser()
        for batch in batches:
            yield pd.Series(tokeniser(batch.tolist()), index=batch.index)

    return df.withColumn(out, run(F.col(column))).withColumn("token_count", F.size(out))


def token_rows(df, ids, tokens="tokens"):
    """Long form: one row per token with its position in the array."""
    return df.select(*ids, F.posexplode(tokens).alias("pos", "token"))


def lemmatise(rows, lemmas, ids, lowercase=settings.LOWERCASE):
    """Replace each token by its lemma from a (form, lemma) table, itself if unlisted.

    Works on the long form; a frequent token is spread over tasks by document and position.
    """
    keyed = rows.withColumn("form", F.lower("token"))
    joined = lookup_join(keyed, lemmas, "form", spread=[*ids, "pos"])
    term = F.coalesce("lemma", "token")
    return joined.select(*ids, "pos", (F.lower(term) if lowercase else term).alias("term"))


def with_row_id(df, name="_row"):
    """`df` written down with a number per row that stays the same between reads."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


LEMMA_ROWS = 2_000_000


def lemmatise_arrays(df, lemmas, column="tokens", lowercase=settings.LOWERCASE):
    """The same on token arrays, at any size of the lemma table. A NULL array stays NULL and an empty one empty.

    A table within `LEMMA_ROWS` rows and the byte bound of joins goes to every node, and arrays are rewritten in place, in
    Arrow batches: no token is moved. With a larger one the tokens that are probably listed, by a table of bits, are joined in
    the long form, and the lemmas come back to their arrays by a row number, so rows need no key and may be equal.
    """
    lemmas = materialise(lemmas.groupBy("form").agg(F.min("lemma").alias("lemma"))
                         .where("form is not null and lemma is not null"), "lemmas")
    if has_at_most(lemmas, LEMMA_ROWS):
        lemma = F.lower("lemma") if lowercase else F.col("lemma")
        known = lemmas.select("form", lemma.alias("lemma")).toArrow()
        shared = df.sparkSession.sparkContext.broadcast([known[c].combine_chunks() for c in ("form", "lemma")])

        @F.arrow_udf("array<string>")
        def replaced(tokens: pa.Array, forms: pa.Array) -> pa.Array:
            return replace_in_lists(tokens, forms, *shared.value)

        @F.arrow_udf("array<string>")
        def replaced_forms(forms: pa.Array) -> pa.Array:
            return replace_in_lists(forms, forms, *shared.value)

        lowered = F.transform(column, F.lower)
        return df.withColumn(column, replaced_forms(lowered) if lowercase else replaced(F.col(column), lowered))
    numbered = with_row_id(df)
    listed = token_rows(numbered.select("_row", column), ["_row"], column).select("_row", "pos", F.lower("token").alias("form"))
    hits = lookup_join(likely_in(listed, lemmas, ["form"]), lemmas, "form", "inner", spread=["_row", "pos"])
    hits = hits.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("_hits"))

    @F.arrow_udf("array<string>")
    def patched(tokens: pa.Array, places: pa.Array, lemmas: pa.Array) -> pa.Array:
        return patch_lists(tokens, places, lemmas)

    joined = numbered.join(hits, "_row", "left")
    done = joined.withColumn(column, patched(F.col(column), F.col("_hits.pos"), F.col("_hits.lemma")))
    return (done.withColumn(column, F.transform(column, F.lower)) if lowercase else done).select(*df.columns)


def list_offsets(lists):
    """Where each list begins in the flat values of an Arrow list column, and where the last one ends."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), np.int64)
    return np.concatenate([[0], np.cumsum(lengths)])


def replace_in_lists(lists, forms, known, lemmas):
    """An Arrow list column whose elements with a form in `known` become the lemma at its place there."""
    at = pa.compute.index_in(forms.flatten(), value_set=known)
    values = pa.compute.coalesce(lemmas.take(at), lists.flatten())
    return pa.ListArray.from_arrays(pa.array(list_offsets(lists).astype(np.int32)), values, mask=lists.is_null())


def patch_lists(lists, places, lemmas):
    """An Arrow list column with the lemmas of a row at its places, which are ascending."""
    offsets, values = list_offsets(lists), lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(list_offsets(places)))
    mask = np.zeros(len(values), bool)
    mask[offsets[row] + np.asarray(places.flatten())] = True
    values = pa.compute.replace_with_mask(values, pa.array(mask), lemmas.flatten())
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values, mask=lists.is_null())


def token_arrays(rows, ids, term="term", out="tokens"):
    """Back to one array per document; a document's tokens fitted in one row before."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", F.col(term).alias("t"))))
    return rows.groupBy(*ids).agg(F.transform(pairs, lambda p: p["t"]).alias(out))
