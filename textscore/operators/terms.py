"""Document frequencies, vocabularies and TF-IDF weights in long form."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from textscore.functions.text import ngrams
from textscore.operators import joins
from textscore.operators.joins import lookup_join
from textscore.operators.ordering import Ordered
from textscore.sources.work import materialise

WINDOWS = 1 << 20        # n-grams put together at once
HELD = 32 * 2 ** 20      # bytes of n-grams that a task counts at once


def ngram_counts(docs, n, tokens="tokens"):
    """(term, occurrences) of all n-grams within the rows' token arrays.

    Tasks count runs of about `HELD` bytes of n-grams, so a task holds the same however long its share of the input is,
    and a frequent n-gram leaves it as one row a run. The counts are dealt by term and added up there.
    """
    windows, held_bytes = WINDOWS, HELD

    def counted(parts):
        found = pa.table({"term": pa.chunked_array(parts)}).group_by("term", use_threads=False).aggregate([([], "count_all")])
        return found.select(["term", "count_all"]).rename_columns(["term", "occurrences"]).to_batches(max_chunksize=1 << 16)

    def run(batches):
        held = []
        for batch in batches:
            lists = batch.column(0)
            words = lists.flatten()
            lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            row = np.repeat(np.arange(len(lengths)), lengths)
            for lo in range(0, len(words) - n + 1, windows):
                hi = min(lo + windows, len(words) - n + 1)
                grams = pc.binary_join_element_wise(
                    *[words.slice(lo + k, hi - lo) for k in range(n)], " ", null_handling="skip")
                held.append(grams.filter(pa.array(row[lo:hi] == row[lo + n - 1:hi + n - 1])))
                if sum(g.nbytes for g in held) >= held_bytes:
                    yield from counted(held)
                    held = []
        if held:
            yield from counted(held)

    parts = docs.select(tokens).mapInArrow(run, "term string, occurrences long")
    return parts.repartition("term").groupBy("term").agg(F.sum("occurrences").alias("occurrences"))


def _exploded(df, ids, tokens, max_ngram, distinct=False):
    """Rows (ids, ngram, term) of all 1..max_ngram-grams."""
    grams = [ngrams(F.col(tokens), n) for n in range(1, max_ngram + 1)]
    if distinct:
        grams = [F.array_distinct(g) for g in grams]
    by_size = df.select(*ids, F.posexplode(F.array(*grams)).alias("n0", "terms"))
    return by_size.select(*ids, (F.col("n0") + 1).alias("ngram"), F.explode("terms").alias("term"))


def document_frequency(docs, max_ngram=1, tokens="tokens"):
    """(ngram, term, df). A document is one row, so its terms are made distinct in place and
    the counts combine map-side: no distinct shuffle, no hot term."""
    rows = _exploded(docs, [], tokens, max_ngram, distinct=True)
    return rows.groupBy("ngram", "term").agg(F.count("*").alias("df"))


def corpus_frequency(docs, max_ngram=1, tokens="tokens"):
    """(ngram, term, df, cf): documents with the term, and its occurrences."""
    once = _exploded(docs, [], tokens, max_ngram, distinct=True)
    every = _exploded(docs, [], tokens, max_ngram)
    both = (once.select("ngram", "term", F.lit(1).alias("d"), F.lit(0).alias("c"))
            .unionByName(every.select("ngram", "term", F.lit(0).alias("d"), F.lit(1).alias("c"))))
    return both.groupBy("ngram", "term").agg(F.sum("d").alias("df"), F.sum("c").alias("cf"))


def smoothed_idf(n, df="df"):
    return F.log((1.0 + n) / (1.0 + F.col(df))) + 1.0


def within_bounds(min_df, max_df, n):
    """A count below, a share of the `n` documents above, both inclusive."""
    return (F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * n)


def fit_vocabulary(docs, min_df=1, max_df=1.0, max_ngram=1, max_features=None, tokens="tokens"):
    """(term, ngram, df, idf) of the terms within the bounds; empty documents count in n.

    A written table, as whatever applies it reads it several times.
    `max_features` keeps the terms most frequent in the corpus, equal ones by spelling.
    """
    n = docs.agg(F.count("*")).scalar()
    if max_features is None:
        kept = document_frequency(docs, max_ngram, tokens).where(within_bounds(min_df, max_df, n))
    else:
        kept = (corpus_frequency(docs, max_ngram, tokens).where(within_bounds(min_df, max_df, n))
                .orderBy(F.desc("cf"), "term").limit(max_features))
    fitted = kept.select("term", "ngram", "df", smoothed_idf(n).alias("idf"))
    return materialise(fitted, "vocabulary")


def term_counts(units, key, order=None, max_ngram=1, tokens="tokens", vocabulary=None):
    """(key, ngram, term, tf) of each key's concatenated tokens.

    N-grams inside a row come from its array. With several rows per key (`order` given) those
    across row borders come from the few tokens at the borders, see `_seams`. Terms outside a
    `vocabulary` are dropped: before they are counted if it may be broadcast; else most of them then, by a table of
    bits, and the rest after that, as counts are fewer rows to move and no term has more of them than there are keys.
    """
    units = units.where(F.col(key).isNotNull())
    parts = [_exploded(units, [key], tokens, max_ngram)]
    if order and max_ngram > 1:
        parts.append(_seams(units, key, list(order), max_ngram, tokens))
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    known = None if vocabulary is None else vocabulary.select("ngram", "term").distinct()
    small = known is not None and joins.has_at_most(known, joins.BROADCAST_ROWS, joins.BROADCAST_BYTES)
    if small:
        rows = rows.join(F.broadcast(known), ["ngram", "term"])
    elif known is not None:
        rows = joins.likely_in(rows, known, ["ngram", "term"])
    counts = rows.groupBy(key, "ngram", "term").agg(F.count("*").alias("tf"))
    return counts if small or known is None else term_join(counts, known)


def term_join(counts, dim):
    """Counts, or what is made of them, with a table of terms of any size."""
    return lookup_join(counts, dim, ["ngram", "term"], "inner", salts=1)


def _seams(units, key, order, max_ngram, tokens):
    """N-grams that cross from one row of a key into the next ones.

    Each row carries in the last `max_ngram - 1` tokens before it. They are built up row by
    row along slices of the order, so a key with very many rows is not one group.
    """
    width = max_ngram - 1
    t = F.col(tokens)
    edges = units.where(F.size(t) > 0).select(
        key, *order,
        F.slice(t, 1, width).alias("head"),
        F.slice(t, F.greatest(F.size(t) - width + 1, F.lit(1)), width).alias("tail"))
    ordered = Ordered(edges, [key, *order], "edges")
    # Every row holds a token, so `width` rows back reach far enough.
    state = F.struct(F.col(key).alias("key"), F.col("tail").alias("tail"))
    ordered.previous("_p1", state)
    for step in range(2, width + 1):
        ordered.previous(f"_p{step}", F.col(f"_p{step - 1}"))
    parts = [F.when(F.col(f"_p{s}")["key"] == F.col(key), F.col(f"_p{s}")["tail"])
             for s in range(width, 0, -1)]
    empty = F.array().cast("array<string>")
    before = F.concat(*[F.coalesce(p, empty) for p in parts])
    edge = ordered.result().select(key, "head", F.slice(
        before, F.greatest(F.size(before) - width + 1, F.lit(1)), width).alias("before"))
    grams = [_crossing(edge, key, n) for n in range(2, max_ngram + 1)]
    return reduce(lambda a, b: a.unionByName(b), grams)


def _crossing(edge, key, n):
    """N-grams that start before a row border and end in the row it opens."""
    left = F.slice("before", F.greatest(F.size("before") - (n - 2), F.lit(1)), n - 1)
    both = edge.select(key, left.alias("l"), F.slice("head", 1, n - 1).alias("r"))
    both = both.withColumn("grams", ngrams(F.concat("l", "r"), n))
    across = F.filter("grams", lambda _, i: (i < F.size("l")) & (i + n > F.size("l")))
    return both.select(key, F.lit(n).alias("ngram"), F.explode(across).alias("term"))


def weigh(counts, vocabulary, key):
    """(key, term, tf, weight): counts times idf; terms outside the vocabulary vanish."""
    vocabulary = vocabulary.select("ngram", "term", "idf")
    joined = term_join(counts, vocabulary)
    return joined.select(key, "ngram", "term", "tf", (F.col("tf") * F.col("idf")).alias("weight"))


def normalise(weights, key):
    """Scale each key's weights to length 1.

    The lengths are summed map-side to one row per key and joined back, so no task has to
    hold a key's whole row of weights.
    """
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    joined = lookup_join(weights, norms, key, "inner", spread=["ngram", "term"])
    return joined.select(*weights.columns, (F.col("weight") / F.col("norm")).alias("tfidf"))


def tfidf(counts, vocabulary, key):
    """(key, ngram, term, tf, weight, tfidf), rows of unit length per key.

    The weights are written once: lengths, their size check and the result all read them.
    """
    return normalise(materialise(weigh(counts, vocabulary, key), "weights"), key)


def sparse_vectors(weights, vocabulary, key, size=None):
    """(key, features): one sparse Spark ML vector per key, terms in spelling order.

    A row holds at most the vocabulary, which Spark ML needs on every node anyway. The vectors are written as the
    structs that store them and read back under their type, so no row passes through Python.
    """
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructType

    from textscore.operators.ordering import row_index

    indexed = row_index(vocabulary.select("ngram", "term"), ["term", "ngram"], "idx")
    size = size or indexed.count()
    rows = term_join(weights, indexed)

    # The fields of a stored vector; type 0 is a sparse one.
    pairs = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("tfidf").cast("double").alias("tfidf"))))
    stored = rows.groupBy(key).agg(pairs.alias("pairs")).select(key, F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).cast("int").alias("size"),
        F.col("pairs.idx").alias("indices"), F.col("pairs.tfidf").alias("values")).alias("features"))
    schema = StructType([stored.schema[key]]).add("features", VectorUDT())
    return materialise(stored, "vectors", schema)


def wide(weights, key, names, column="tfidf"):
    """One row per key and one column per listed term, 0 where it is absent."""
    pivoted = weights.groupBy(key).pivot("term", list(names)).agg(F.sum(column))
    return pivoted.na.fill(0.0, list(names))
