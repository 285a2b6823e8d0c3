"""Vocabularies from conversations, TF-IDF of documents by source."""

from pyspark.sql import functions as F

from textscore import settings
from textscore.catalog.common import (STOPWORDS, rounded, sql_frequencies, sql_tfidf,
                                      sql_vocabulary, texts)
from textscore.catalog.text import documents
from textscore.operators import grid, terms
from textscore.plans import search, tokens
from textscore.sources.work import materialise

TOPICS = ("thetion", "erand", "ention", "leou", "inon")


def ads(spark, sf):
    return tokens.tokenise(texts(spark, sf, "conversations", "conv_id", "turn"), "text", stopwords=STOPWORDS)


def speeches(spark, sf):
    """The tokenised table, written as the stages hand it on."""
    return materialise(documents(spark, sf).select(
        "doc_id", F.col("source").alias("unique_id"), "tokens", "n_chars"), "speeches")


def vocabulary(spark, sf):
    return terms.fit_vocabulary(ads(spark, sf), 2, 0.5, 2)


def document_weights(spark, sf):
    """TF-IDF of all of a source's documents, written once for the queries that reread it."""
    known = vocabulary(spark, sf)
    counts = terms.term_counts(speeches(spark, sf), "unique_id", ["doc_id"], 2, vocabulary=known)
    return terms.tfidf(counts, known, "unique_id")


def vocab_fit(spark, sf):
    return rounded(vocabulary(spark, sf), "idf")


def max_features(spark, sf):
    kept = terms.fit_vocabulary(ads(spark, sf), 2, 0.5, 2, max_features=1000)
    return rounded(kept, "idf")


def tfidf_transform(spark, sf):
    return rounded(document_weights(spark, sf), "tfidf").select(
        "unique_id", "ngram", "term", "tf", "tfidf")


def _grid_configs(spark, sf):
    corpus = ads(spark, sf)
    parameters = grid.Grid(settings.MIN_DF, settings.MAX_DF, settings.MAX_NGRAM)
    n = corpus.agg(F.count("*")).scalar()
    cells = parameters.cells(terms.document_frequency(corpus, 2), n)
    return parameters, parameters.vocabularies(cells, n, settings.MIN_VOCAB)


def vocab_grid(spark, sf):
    _, configs = _grid_configs(spark, sf)
    return configs.withColumn("valid", F.col("error").isNull())


def limited_grid(spark, sf):
    """The grid with limits on the number of terms: each config's vocabulary, summed up."""
    parameters = grid.Grid(settings.LIMITED_MIN_DF, (1.0,), settings.MAX_NGRAM, settings.LIMITED_MAX_FEATURES)
    corpus = ads(spark, sf)
    n = corpus.agg(F.count("*")).scalar()
    rows = parameters.to_configs(materialise(parameters.cells(terms.corpus_frequency(corpus, 2), n), "cells"))
    found = rows.groupBy("config").agg(
        F.count("*").alias("vocab_size"), F.sum("df").alias("total_df"), F.sum("cf").alias("total_cf"),
        F.min("cf").alias("least_cf"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))
    return parameters.frame(spark).join(F.broadcast(found), "config")


def grid_failures(spark, sf):
    parameters, configs = _grid_configs(spark, sf)
    bad = parameters.with_alphas(configs.where("error is not null"), settings.ALPHAS)
    return search.failed(bad, F.lit(0).cast("bigint"))


def feature_vectors(spark, sf):
    """Sparse vectors and what is in them."""
    from pyspark.ml.functions import vector_to_array

    weights = document_weights(spark, sf)
    vectors = terms.sparse_vectors(weights, vocabulary(spark, sf), "unique_id")
    values = vector_to_array("features")
    return vectors.select(
        "unique_id", F.size(values).alias("width"),
        F.size(F.filter(values, lambda x: x != 0)).alias("filled"),
        F.round(F.aggregate(values, F.lit(0.0), lambda t, x: t + x), 6).alias("total"))


def wide_table(spark, sf):
    return rounded(terms.wide(document_weights(spark, sf), "unique_id", TOPICS), *TOPICS)


QUERIES = {f.__name__: f for f in (
    vocab_fit, max_features, tfidf_transform, vocab_grid, limited_grid, grid_failures, feature_vectors,
    wide_table)}

GRID_CTE = f"""{sql_frequencies()},
    points AS (
        SELECT (i * 7 + j) * 2 + k AS config, min_df, max_df, max_ngram
        FROM (SELECT unnest([2, 5, 10, 100]) AS min_df, unnest([0, 1, 2, 3]) AS i),
             (SELECT unnest([0.01, 0.05, 0.1, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS max_df,
                     unnest([0, 1, 2, 3, 4, 5, 6]) AS j),
             (SELECT unnest([1, 2]) AS max_ngram, unnest([0, 1]) AS k)),
    sizes AS (
        SELECT config, any_value(p.min_df) AS min_df, any_value(p.max_df) AS max_df,
               any_value(p.max_ngram) AS max_ngram, any_value(n) AS n, count(term) AS vocab_size
        FROM points p CROSS JOIN corpus
        LEFT JOIN df_table ON df >= p.min_df AND df <= p.max_df * n AND ngram <= p.max_ngram
        GROUP BY config),
    configs AS (
        SELECT config, min_df, max_df, max_ngram, vocab_size,
               CASE WHEN max_df * n < min_df
                      THEN '{grid.BOUNDS_ERROR}'
                    WHEN vocab_size = 0
                      THEN '{grid.EMPTY_ERROR}'
                    WHEN vocab_size < 50
                      THEN 'Vocabulary too small (size=' || vocab_size
                           || ' < min_vocab=50) for min_df=' || min_df || ', max_df=' || max_df
               END AS error
        FROM sizes)"""

ORACLE = {
    "vocab_fit": f"WITH {sql_vocabulary()} SELECT term, ngram, df, round(idf, 6) AS idf FROM vocab",
    "max_features": f"""
        WITH {sql_frequencies()}
        SELECT term, ngram, df,
               round(ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1, 6) AS idf
        FROM df_table, corpus WHERE df >= 2 AND df <= 0.5::DOUBLE * n
        ORDER BY cf DESC, term LIMIT 1000""",
    "tfidf_transform": f"""
        WITH {sql_tfidf()}
        SELECT key AS unique_id, ngram, term, tf, round(tfidf, 6) AS tfidf FROM tfidf""",
    "vocab_grid": f"WITH {GRID_CTE} SELECT *, error IS NULL AS valid FROM configs",
    "limited_grid": f"""
        WITH {sql_frequencies()},
        bases AS (SELECT unnest([2, 2, 5, 5]) AS min_df, unnest([1, 2, 1, 2]) AS max_ngram, unnest([0, 1, 2, 3]) AS b),
        ranked AS (
            SELECT b, min_df, max_ngram, df, cf, term,
                   row_number() OVER (PARTITION BY b ORDER BY cf DESC, term, ngram) AS place
            FROM bases p JOIN df_table d ON d.df >= p.min_df AND d.ngram <= p.max_ngram),
        limits AS (SELECT unnest([1000, 5000, 10000]) AS max_features, unnest([0, 1, 2]) AS k)
        SELECT b * 3 + k AS config, min_df, 1.0::DOUBLE AS max_df, max_ngram, max_features, count(*) AS vocab_size,
               sum(df) AS total_df, sum(cf) AS total_cf, min(cf) AS least_cf, min(term) AS first_term, max(term) AS last_term
        FROM ranked JOIN limits ON place <= max_features GROUP BY ALL""",
    "grid_failures": f"""
        WITH {GRID_CTE},
        alphas AS (SELECT unnest([0.1, 1, 10, 100, 1000]::DOUBLE[]) AS ridge_alpha,
                          unnest([0, 1, 2, 3, 4]) AS a)
        SELECT config * 5 + a AS grid_pos, min_df, max_df, ridge_alpha, max_ngram,
               0::BIGINT AS vocab_size, -999.0::DOUBLE AS cv_r2_mean, 0.0::DOUBLE AS cv_r2_std,
               999.0::DOUBLE AS cv_mse_mean, 0.0::DOUBLE AS cv_mse_std,
               -999.0::DOUBLE AS train_r2, 0.0::DOUBLE AS evaluation_time, false AS success, error
        FROM configs CROSS JOIN alphas WHERE error IS NOT NULL""",
    "feature_vectors": f"""
        WITH {sql_tfidf()}
        SELECT key AS unique_id, CAST((SELECT count(*) FROM vocab) AS INTEGER) AS width,
               CAST(count(*) AS INTEGER) AS filled, round(sum(tfidf), 6) AS total
        FROM tfidf GROUP BY key""",
    "wide_table": f"""
        WITH {sql_tfidf()}
        SELECT key AS unique_id, """ + ", ".join(
        f"round(coalesce(sum(tfidf) FILTER (term = '{t}'), 0), 6) AS {t}" for t in TOPICS)
        + " FROM tfidf GROUP BY key",
}
