"""Tokens, lemmas and speakers on documents."""

from pyspark.sql import functions as F

from textscore.catalog.common import STOPWORDS, sql_documents, sql_tokens, table, texts
from textscore.operators import terms
from textscore.operators.joins import lookup_join
from textscore.plans import report, speakers, tokens
from textscore.sources.work import materialise

CHUNK = 1000


def documents(spark, sf, stopwords=STOPWORDS):
    docs = texts(spark, sf, "documents", "doc_id")
    return tokens.tokenise(docs, "text", stopwords=stopwords)


def tokenize(spark, sf):
    return documents(spark, sf).select(
        "doc_id", "token_count", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def token_switches(spark, sf):
    docs = tokens.tokenise(texts(spark, sf, "documents", "doc_id"), "text", remove_stopwords=False,
                           lowercase=False)
    return docs.select("doc_id", "token_count",
                       F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def _lemmas(spark, sf):
    """Lemma table from the other corpus: a form ending in -s goes to the form without it."""
    other = tokens.tokenise(texts(spark, sf, "conversations", "conv_id", "turn"), "text", stopwords=STOPWORDS)
    forms = other.select(F.explode("tokens").alias("form")).where("form like '%s'").distinct()
    return forms.select("form", F.regexp_replace("form", "s$", "").alias("lemma"))


def lemma_lookup(spark, sf):
    lemmas = _lemmas(spark, sf)
    arrays = tokens.lemmatise_arrays(documents(spark, sf), lemmas, "tokens")
    return arrays.select("doc_id", "token_count",
                         F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def lemma_join(spark, sf):
    """The same on the long form; documents without a token are not in it."""
    lemmas = _lemmas(spark, sf)
    rows = tokens.token_rows(documents(spark, sf), ["doc_id"])
    arrays = tokens.token_arrays(tokens.lemmatise(rows, lemmas, ["doc_id"]), ["doc_id"])
    return arrays.select("doc_id", F.size("tokens").alias("token_count"),
                         F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def token_stats(spark, sf):
    stats = report.token_stats(documents(spark, sf))
    return stats.withColumn("mean_tokens", F.round("mean_tokens", 6))


def _speeches(spark, sf):
    quality = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("gen_vote_pct"))
    speeches = documents(spark, sf).select(
        "doc_id", F.nullif("source", F.lit("src3")).alias("unique_id"), "tokens",
        F.when(F.col("lang") == "en", F.col("n_chars")).alias("dime"))
    return materialise(lookup_join(speeches, quality, "doc_id"), "speeches")


def speaker_first_values(spark, sf):
    return speakers.speaker_scores(_speeches(spark, sf), ["doc_id"])


def speaker_aggregate(spark, sf):
    return _chunks(_speeches(spark, sf), ["doc_id"])


def _chunks(speeches, order):
    chunks = speakers.speaker_chunks(speeches, order, size=CHUNK)
    return chunks.select("unique_id", "chunk", F.size("tokens").alias("chunk_tokens"),
                         F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def speaker_aggregate_repeats(spark, sf):
    """Every English speech twice, as two score rows of one cycle leave it; the order is not unique."""
    twice = F.explode(F.when(F.col("lang") == "en", F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1))))
    speeches = documents(spark, sf).select(
        "doc_id", F.col("source").alias("unique_id"), "tokens", twice.alias("cycle"))
    return _chunks(speeches, ["doc_id", "cycle"])


def ngrams(spark, sf):
    return terms.ngram_counts(documents(spark, sf), 2)


QUERIES = {f.__name__: f for f in (
    tokenize, token_switches, lemma_lookup, lemma_join, token_stats, speaker_first_values,
    speaker_aggregate, speaker_aggregate_repeats, ngrams)}

ORACLE = {
    "tokenize": f"""
        WITH {sql_documents()}
        SELECT id AS doc_id, CAST(len(tokens) AS INTEGER) AS token_count,
               md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM docs""",
    "token_switches": f"""
        WITH docs AS (SELECT doc_id, {sql_tokens('text', [], False)} AS tokens FROM documents)
        SELECT doc_id, CAST(len(tokens) AS INTEGER) AS token_count,
               md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM docs""",
    "lemma_join": f"""
        WITH {sql_documents()},
        forms AS (SELECT DISTINCT form FROM (
                      SELECT unnest({sql_tokens('text')}) AS form FROM conversations)
                  WHERE form LIKE '%s'),
        rows AS (SELECT id, pos, CASE WHEN form IS NULL THEN token
                                      ELSE left(token, length(token) - 1) END AS term
                 FROM docs_rows LEFT JOIN forms ON token = form)
        SELECT id AS doc_id, CAST(count(*) AS INTEGER) AS token_count,
               md5(string_agg(term, ' ' ORDER BY pos)) AS tokens_md5
        FROM rows GROUP BY id""",
    "lemma_lookup": f"""
        WITH {sql_documents()},
        forms AS (SELECT DISTINCT form FROM (
                      SELECT unnest({sql_tokens('text')}) AS form FROM conversations)
                  WHERE form LIKE '%s')
        SELECT id AS doc_id, CAST(len(any_value(tokens)) AS INTEGER) AS token_count,
               md5(coalesce(string_agg(CASE WHEN form IS NULL THEN token
                                       ELSE left(token, length(token) - 1) END, ' ' ORDER BY pos),
                            '')) AS tokens_md5
        FROM docs LEFT JOIN docs_rows USING (id) LEFT JOIN forms ON token = form
        GROUP BY id""",
    "token_stats": f"""
        WITH {sql_documents()}
        SELECT count(*) AS rows, round(avg(len(tokens)), 6) AS mean_tokens,
               CAST(min(len(tokens)) AS INTEGER) AS min_tokens,
               CAST(max(len(tokens)) AS INTEGER) AS max_tokens,
               CAST(median(len(tokens)) AS DOUBLE) AS median_tokens FROM docs""",
    "speaker_first_values": f"""
        WITH {sql_documents()},
        speeches AS (
            SELECT d.doc_id, d.source AS unique_id, l.quality AS gen_vote_pct,
                   CASE WHEN d.lang = 'en' THEN d.n_chars END AS dime, len(t.tokens) AS tokens
            FROM documents d JOIN docs t ON t.id = d.doc_id
            LEFT JOIN labels l ON l.doc_id = d.doc_id
            WHERE d.source <> 'src3')
        SELECT unique_id, arg_min(gen_vote_pct, doc_id) FILTER (gen_vote_pct IS NOT NULL)
                   AS gen_vote_pct,
               arg_min(dime, doc_id) FILTER (dime IS NOT NULL) AS dime,
               count(*) AS speeches, CAST(sum(tokens) AS BIGINT) AS token_count
        FROM speeches GROUP BY unique_id""",
    "speaker_aggregate": f"""
        WITH {sql_documents()},
        placed AS (SELECT key, token,
                          row_number() OVER (PARTITION BY key ORDER BY id, pos) - 1 AS place
                   FROM docs_rows WHERE key <> 'src3')
        SELECT key AS unique_id, CAST(place // {CHUNK} AS BIGINT) AS chunk,
               CAST(count(*) AS INTEGER) AS chunk_tokens,
               md5(string_agg(token, ' ' ORDER BY place)) AS tokens_md5
        FROM placed GROUP BY 1, 2""",
    "speaker_aggregate_repeats": f"""
        WITH {sql_documents()},
        copies AS (SELECT doc_id AS id, unnest(range(CASE WHEN lang = 'en' THEN 2 ELSE 1 END)) AS copy
                   FROM documents),
        placed AS (SELECT key, token,
                          row_number() OVER (PARTITION BY key ORDER BY id, copy, pos) - 1 AS place
                   FROM docs_rows JOIN copies USING (id))
        SELECT key AS unique_id, CAST(place // {CHUNK} AS BIGINT) AS chunk,
               CAST(count(*) AS INTEGER) AS chunk_tokens,
               md5(string_agg(token, ' ' ORDER BY place)) AS tokens_md5
        FROM placed GROUP BY 1, 2""",
    "ngrams": f"""
        WITH {sql_documents()},
        pairs AS (SELECT token, lead(token) OVER (PARTITION BY id ORDER BY pos) AS next_token
                  FROM docs_rows)
        SELECT token || ' ' || next_token AS term, count(*) AS occurrences
        FROM pairs WHERE next_token IS NOT NULL
        GROUP BY 1""",
}
