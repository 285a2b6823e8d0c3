"""Helpers of the query modules."""

from pyspark.sql import functions as F

from textscore.sources.work import spread

# A short stopword list for the checked queries; any list can be passed.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "by", "de", "el", "en", "for", "in", "is",
             "la", "le", "of", "on", "or", "que", "the", "to", "un", "und", "with"]


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir, name, *keys):
    """A table whose texts are to be tokenised, on all cores."""
    return spread(table(spark, sf_dir, name), *keys)


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def sql_list(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sql_tokens(column, stopwords=STOPWORDS, lower=True):
    """DuckDB expression for the token array of a text column."""
    tails = r"(?i)(n[''’]t|[''’](?:s|re|ve|ll|d|m))([^\p{L}\p{N}]|$)"
    pieces = (rf"string_split_regex(regexp_replace({column}, '{tails}', ' \2', 'g'), "
              r"'[^\p{L}\p{N}]+')")
    stop = f" AND lower(t) NOT IN ({sql_list(stopwords)})" if stopwords else ""
    kept = rf"list_filter({pieces}, lambda t: regexp_full_match(t, '\p{{L}}+'){stop})"
    return f"list_transform({kept}, lambda t: lower(t))" if lower else kept


def sql_documents(name="docs", stopwords=STOPWORDS):
    """CTEs `{name}` (id, key, tokens) and `{name}_rows` (id, key, pos, token)."""
    return f"""
    {name} AS (SELECT doc_id AS id, source AS key, {sql_tokens('text', stopwords)} AS tokens
               FROM documents),
    {name}_rows AS (SELECT id, key, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token
                    FROM {name})"""


def sql_frequencies():
    """CTEs for the vocabulary corpus: `ads`, `grams` (doc, ngram, term), `df_table`."""
    return f"""
    ads AS (SELECT row_number() OVER () AS doc, {sql_tokens('text')} AS tokens
            FROM conversations),
    ad_rows AS (SELECT doc, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token FROM ads),
    pairs AS (SELECT doc, token, lead(token) OVER (PARTITION BY doc ORDER BY pos) AS next_token
              FROM ad_rows),
    grams AS (SELECT doc, 1 AS ngram, token AS term FROM pairs
              UNION ALL
              SELECT doc, 2, token || ' ' || next_token FROM pairs WHERE next_token IS NOT NULL),
    corpus AS (SELECT count(*) AS n FROM ads),
    df_table AS (SELECT ngram, term, count(DISTINCT doc) AS df, count(*) AS cf
                 FROM grams GROUP BY ngram, term)"""


def sql_vocabulary(min_df=2, max_df=0.5, max_ngram=2):
    return f"""{sql_frequencies()},
    vocab AS (SELECT term, ngram, df, ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1 AS idf
              FROM df_table, corpus
              WHERE df >= {min_df} AND df <= {max_df}::DOUBLE * n AND ngram <= {max_ngram})"""


def sql_tfidf(**bounds):
    """CTE `tfidf` (key, ngram, term, tf, weight, tfidf) of documents by source."""
    return f"""{sql_vocabulary(**bounds)},{sql_documents()},
    doc_pairs AS (SELECT key, token,
                         lead(token) OVER (PARTITION BY key ORDER BY id, pos) AS next_token
                  FROM docs_rows),
    doc_grams AS (SELECT key, 1 AS ngram, token AS term FROM doc_pairs
                  UNION ALL
                  SELECT key, 2, token || ' ' || next_token FROM doc_pairs
                  WHERE next_token IS NOT NULL),
    counts AS (SELECT key, ngram, term, count(*) AS tf FROM doc_grams GROUP BY key, ngram, term),
    weighed AS (SELECT key, ngram, term, tf, tf * idf AS weight
                FROM counts JOIN vocab USING (ngram, term)),
    tfidf AS (SELECT *, weight / sqrt(sum(weight * weight) OVER (PARTITION BY key)) AS tfidf
              FROM weighed)"""
