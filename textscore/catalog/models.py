"""Folds, ridge, search, report and scoring."""

import uuid

from pyspark.sql import functions as F

from textscore import settings
from textscore.catalog.common import rounded, sql_tfidf, sql_vocabulary, table
from textscore.catalog.vocabulary import (GRID_CTE, _grid_configs, ads, document_weights, speeches,
                                          vocabulary)
from textscore.operators import gram, ridge, terms
from textscore.operators.joins import lookup_join
from textscore.operators.ordering import contiguous_folds, row_index
from textscore.plans import embed, report, search
from textscore.sources import writers
from textscore.sources.work import materialise, work_dir

ALPHAS = (0.1, 1.0, 10.0)


def folds(spark, sf):
    return contiguous_folds(table(spark, sf, "labels"), ["doc_id"], 5).select("doc_id", "fold")


def _lengths(spark, sf):
    """Text length in thousands, of all documents."""
    return table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") / 1000.0).alias("x")).withColumn("features", F.array("x"))


def _one_feature(spark, sf):
    """The labelled documents: length against the quality label."""
    labelled = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("y"))
    return _lengths(spark, sf).join(labelled, "doc_id")


def _fold_fits(spark, sf, alphas):
    folded = contiguous_folds(_one_feature(spark, sf), ["doc_id"], 5)
    grams = ridge.augmented_gram(folded, "features", width=1)
    return ridge.solve_folds(grams, 5, alphas)


def ridge_one_feature(spark, sf):
    data = materialise(_one_feature(spark, sf).withColumn("fold", F.lit(0)), "one_feature")
    grams = ridge.augmented_gram(data, "features", width=1)
    fit = ridge.solve_folds(grams, 1, [1.0]).where(F.col("fit") == ridge.FULL).first()
    scored = embed.score_embeddings(_lengths(spark, sf), fit, "features")
    return rounded(scored.select("doc_id", "prediction"), "prediction")


def ridge_one_feature_ml(spark, sf):
    from pyspark.ml.functions import array_to_vector

    vector = array_to_vector("features")
    data = materialise(_one_feature(spark, sf), "one_feature").withColumn("features", vector)
    model = ridge.fit_linear(data, 1.0, solver="normal")
    scored = model.transform(_lengths(spark, sf).withColumn("features", vector))
    return rounded(scored.select("doc_id", "prediction"), "prediction")


def cv_metrics(spark, sf):
    fits = _fold_fits(spark, sf, ALPHAS)
    return rounded(fits.select(
        "fit", "alpha", "n", ridge.r2(F.col("sse"), F.col("sst"), F.col("n")).alias("r2"),
        (F.col("sse") / F.col("n")).alias("mse")), "r2", "mse")


def cv_summary(spark, sf):
    return rounded(ridge.cv_summary(_fold_fits(spark, sf, ALPHAS), ["alpha"]),
                   "cv_r2_mean", "cv_r2_std", "cv_mse_mean", "cv_mse_std", "train_r2")


def _indexed_weights(spark, sf):
    weights = document_weights(spark, sf)
    names = row_index(weights.select("unique_id").distinct(), ["unique_id"], "i")
    names = materialise(names.select("unique_id", F.col("i").cast("int").alias("i")), "names")
    return lookup_join(weights, names, "unique_id", "inner", spread=["ngram", "term"]), names


def gram_matrix(spark, sf):
    """Products of all pairs of sources' TF-IDF rows."""
    weights, names = _indexed_weights(spark, sf)
    n = names.count()
    numbers = materialise(row_index(weights.select("ngram", "term").distinct(), ["term", "ngram"], "t"), "terms")
    entries = terms.term_join(weights.select("i", "ngram", "term", F.col("tfidf").alias("weight")), numbers)
    pairs = gram.tile_products(gram.tiles(materialise(entries.select("i", "t", "weight"), "entries"), n, numbers.count()), n)
    named = (pairs.join(F.broadcast(names.select("i", F.col("unique_id").alias("a"))), "i")
             .join(F.broadcast(names.select(F.col("i").alias("j"), F.col("unique_id").alias("b"))), "j"))
    return rounded(named.select("a", "b", "product"), "product")


def term_weights(spark, sf):
    """Terms' weights from given dual coefficients: here a source's position in the order."""
    weights, names = _indexed_weights(spark, sf)
    rows = weights.select("i", "ngram", "term", F.col("tfidf").alias("weight"))
    dual = names.select("i", (F.col("i") - 9.5).alias("coefficient"))
    return rounded(search.term_coefficients(rows, dual, "i"), "coefficient")


def _scored_speeches(spark, sf):
    return speeches(spark, sf).withColumn("dime", F.col("n_chars") / 1000.0).drop("n_chars")


def ridge_search(spark, sf):
    """The whole grid on documents by source, vocabulary from conversations."""
    found = search.grid_search(ads(spark, sf), _scored_speeches(spark, sf), ["doc_id"])
    return found.results.drop("evaluation_time")


def ridge_predictions(spark, sf):
    """Refitted best point of a small grid, applied to the speakers."""
    units = materialise(_scored_speeches(spark, sf), "units")
    found = search.grid_search(ads(spark, sf), units, ["doc_id"], min_df=(2,), max_df=(0.5,),
                               alphas=(1.0,), max_ngram=(1,))
    return found.model.predict(units, "unique_id", ["doc_id"])


def _results(spark, sf):
    """Search results with the vocabulary size in place of R2, failures included."""
    parameters, configs = _grid_configs(spark, sf)
    points = materialise(parameters.with_alphas(configs, settings.ALPHAS), "points")
    good = points.where("error is null").withColumns({
        "cv_r2_mean": F.col("vocab_size") / 77777.0 - F.col("ridge_alpha") / 9999.0,
        "success": F.lit(True)}).drop("config", "error")
    bad = search.failed(points.where("error is not null"), F.lit(0).cast("bigint"))
    return good.unionByName(bad, allowMissingColumns=True)


def search_report(spark, sf):
    out = report.breakdowns(_results(spark, sf))
    return rounded(out, "mean_r2", "max_r2", "mean_vocab")


def search_top(spark, sf):
    return rounded(report.top(_results(spark, sf)).select(
        "grid_pos", "min_df", "max_df", "max_ngram", "ridge_alpha", "vocab_size", "cv_r2_mean"),
        "cv_r2_mean")


def search_totals(spark, sf):
    return report.totals(_results(spark, sf))


def ridge_embeddings(spark, sf):
    fits = embed.embedding_search(table(spark, sf, "embeddings"), "vec_id", "label")
    return rounded(embed.embedding_scores(fits), "cv_r2_mean", "cv_r2_std", "cv_mse_mean",
                   "cv_mse_std", "train_r2")


def _given_model(spark, sf):
    params = spark.range(1).select(F.lit(0.5).alias("intercept"), F.lit(2).alias("max_ngram"))
    weighted = vocabulary(spark, sf).withColumn("coefficient", 1.0 / F.col("df"))
    return search.Model(materialise(weighted, "given"), params)


def score_documents(spark, sf):
    predictions = _given_model(spark, sf).predict(speeches(spark, sf), "unique_id", ["doc_id"])
    return rounded(predictions, "prediction")


def model_read_back(spark, sf):
    path = f"{work_dir(spark)}/model-{uuid.uuid4().hex}"
    writers.save_model(_given_model(spark, sf), path)
    model = writers.load_model(spark, path)
    return rounded(model.predict(speeches(spark, sf), "unique_id", ["doc_id"]), "prediction")


def holdout_split(spark, sf):
    return embed.holdout(table(spark, sf, "documents"), "doc_id").select("doc_id", "test")


QUERIES = {f.__name__: f for f in (
    folds, ridge_one_feature, ridge_one_feature_ml, cv_metrics, cv_summary, gram_matrix,
    term_weights, ridge_search, ridge_predictions, search_report, search_top, search_totals,
    ridge_embeddings, score_documents, model_read_back, holdout_split)}

ONE_FEATURE = """
    data AS (SELECT doc_id, n_chars / 1000.0::DOUBLE AS x, quality::DOUBLE AS y
             FROM documents JOIN labels USING (doc_id))"""

ONE_FEATURE_SQL = f"""
    WITH {ONE_FEATURE},
    fit AS (SELECT regr_sxy(y, x) / (regr_sxx(y, x) + 1.0) AS w, avg(x) AS mx, avg(y) AS my
            FROM data)
    SELECT doc_id, round(my + w * (n_chars / 1000.0::DOUBLE - mx), 6) AS prediction FROM documents, fit"""

FOLD_ERRORS = f"""{ONE_FEATURE},
    folded AS (SELECT *, CAST(ntile(5) OVER (ORDER BY doc_id) AS INTEGER) - 1 AS fold FROM data),
    fits AS (SELECT unnest([0, 1, 2, 3, 4, -1]) AS fit),
    alphas AS (SELECT unnest([0.1, 1, 10]::DOUBLE[]) AS alpha),
    models AS (SELECT fit, alpha, regr_sxy(y, x) / (regr_sxx(y, x) + alpha) AS w,
                      avg(x) AS mx, avg(y) AS my
               FROM folded, fits, alphas WHERE fold <> fit GROUP BY fit, alpha),
    fold_errors AS (
        SELECT fit, alpha, count(*) AS n,
               1 - sum(pow(y - my - w * (x - mx), 2)) / regr_syy(y, y) AS r2,
               avg(pow(y - my - w * (x - mx), 2)) AS mse
        FROM folded JOIN models ON fold = fit OR fit = -1 GROUP BY fit, alpha)"""

RESULTS_CTE = f"""{GRID_CTE},
    alphas AS (SELECT unnest([0.1, 1, 10, 100, 1000]::DOUBLE[]) AS ridge_alpha,
                      unnest([0, 1, 2, 3, 4]) AS a),
    results AS (
        SELECT config * 5 + a AS grid_pos, min_df, max_df, max_ngram, ridge_alpha, vocab_size,
               vocab_size / 77777.0::DOUBLE - ridge_alpha / 9999.0::DOUBLE AS cv_r2_mean,
               error IS NULL AS success
        FROM configs CROSS JOIN alphas),
    good AS (SELECT * FROM results WHERE success)"""

PREDICTIONS = f"""
    WITH {sql_tfidf()}
    SELECT key AS unique_id, round(sum(tfidf / df) + 0.5, 6) AS prediction
    FROM tfidf JOIN vocab USING (ngram, term) GROUP BY key"""


def _breakdown(column, vocab="round(avg(vocab_size), 6)"):
    return f"""
        SELECT '{column}' AS parameter, {column}::DOUBLE AS value,
               round(avg(cv_r2_mean), 6) AS mean_r2, round(max(cv_r2_mean), 6) AS max_r2,
               {vocab} AS mean_vocab, count(*) AS combos FROM good GROUP BY {column}"""


ORACLE = {
    "folds": """
        SELECT doc_id, CAST(ntile(5) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS fold
        FROM labels""",
    "ridge_one_feature": ONE_FEATURE_SQL,
    "ridge_one_feature_ml": ONE_FEATURE_SQL,
    "cv_metrics": f"""
        WITH {FOLD_ERRORS}
        SELECT fit, alpha, n, round(r2, 6) AS r2, round(mse, 6) AS mse FROM fold_errors""",
    "cv_summary": f"""
        WITH {FOLD_ERRORS}
        SELECT alpha, round(avg(r2) FILTER (fit >= 0), 6) AS cv_r2_mean,
               round(stddev_pop(r2) FILTER (fit >= 0), 6) AS cv_r2_std,
               round(avg(mse) FILTER (fit >= 0), 6) AS cv_mse_mean,
               round(stddev_pop(mse) FILTER (fit >= 0), 6) AS cv_mse_std,
               round(max(r2) FILTER (fit = -1), 6) AS train_r2
        FROM fold_errors GROUP BY alpha""",
    "gram_matrix": f"""
        WITH {sql_tfidf()}
        SELECT l.key AS a, r.key AS b, round(sum(l.tfidf * r.tfidf), 6) AS product
        FROM tfidf l JOIN tfidf r USING (ngram, term) WHERE l.key <= r.key
        GROUP BY l.key, r.key""",
    "term_weights": f"""
        WITH {sql_tfidf()},
        places AS (SELECT key, row_number() OVER (ORDER BY key) - 1 - 9.5::DOUBLE AS c
                   FROM (SELECT DISTINCT key FROM tfidf))
        SELECT ngram, term, round(sum(tfidf * c), 6) AS coefficient
        FROM tfidf JOIN places USING (key) GROUP BY ngram, term""",
    "search_report": f"""
        WITH {RESULTS_CTE}
        {_breakdown('min_df')} UNION ALL {_breakdown('max_df')}
        UNION ALL {_breakdown('ridge_alpha', 'NULL::DOUBLE')}""",
    "search_top": f"""
        WITH {RESULTS_CTE}
        SELECT grid_pos, min_df, max_df, max_ngram, ridge_alpha, vocab_size,
               round(cv_r2_mean, 6) AS cv_r2_mean
        FROM good ORDER BY good.cv_r2_mean DESC, grid_pos LIMIT 5""",
    "search_totals": f"""
        WITH {RESULTS_CTE}
        SELECT count(*) AS tested, count(*) FILTER (success) AS successful,
               count(*) FILTER (NOT success) AS failed FROM results""",
    "score_documents": PREDICTIONS,
    "model_read_back": PREDICTIONS,
    "holdout_split": f"""
        SELECT doc_id, CAST('0x' || left(md5('42:' || doc_id), 8) AS BIGINT)
                       < {int(0.2 * 2 ** 32)} AS test
        FROM documents""",
}
