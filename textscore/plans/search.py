"""Grid search: vocabulary from ads, ridge on speakers, folds over speakers in key order."""

import time
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from textscore import settings
from textscore.operators import gram, grid, krylov, ridge, terms
from textscore.operators.joins import lookup_join
from textscore.operators.ordering import folds_of_index, row_index
from textscore.plans.clean import present
from textscore.plans.speakers import speaker_scores
from textscore.schemas import CV_RESULTS
from textscore.sources.work import materialise


@dataclass
class Model:
    """Fitted weights by term, and what they were fitted with."""

    terms: DataFrame
    params: DataFrame

    def predict(self, units, key, order=None):
        """(key, prediction) for every key of new tokenised rows, the unknown ones included."""
        return predict(self, units, key, order)


@dataclass
class Search:
    results: DataFrame
    best: Row
    model: Model


@dataclass
class Prepared:
    """Shared tables of a search: what is counted once for all configs."""

    grid: grid.Grid
    ads: int
    frequencies: DataFrame
    speakers: DataFrame
    weights: DataFrame
    rows: int


def require(df, columns):
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def target_rows(speeches, order, folds, key="unique_id", target="dime"):
    """(i, key, y, fold) of the speakers with a score, in key order."""
    scored = present(speaker_scores(speeches, order, key, (target,)), target)
    scored = scored.select(key, F.col(target).cast("double").alias("y"))
    indexed = row_index(scored, [key], "i")
    fold = folds_of_index("i", indexed.count(), folds)
    return indexed.select(F.col("i").cast("int").alias("i"), key, "y", fold.alias("fold"))


def prepare(ads, speeches, order, parameters, folds, key="unique_id", target="dime",
            score_order=None):
    """Count everything once: n-grams per speaker, document frequencies, cells."""
    max_ngram = max(parameters.max_ngram)
    n_ads = ads.count()
    count = terms.corpus_frequency if parameters.limited else terms.document_frequency
    frequencies = materialise(parameters.cells(count(ads, max_ngram), F.lit(n_ads)), "frequencies")
    speakers = materialise(target_rows(speeches, score_order or order, folds, key, target), "speakers")
    counts = terms.term_counts(speeches, key, order, max_ngram, vocabulary=frequencies)
    vocabulary = frequencies.withColumn("idf", terms.smoothed_idf(F.lit(n_ads)))
    weights = terms.term_join(counts, vocabulary)
    weights = lookup_join(weights, speakers.select("i", key), key, "inner", spread=["ngram", "term"])
    weights = materialise(weights.select(
        "i", key, *grid.CELL, "term", (F.col("tf") * F.col("idf")).alias("weight")), "weights")
    return Prepared(parameters, n_ads, frequencies, speakers, weights, speakers.count())


def with_nothing(grams, spark, configs):
    """Add an empty row per config: one whose terms no speaker uses has a matrix of zeros."""
    empty = spark.range(1).select(
        F.explode(F.array([F.lit(c) for c in configs])).alias("config"), F.lit(0).alias("i"),
        F.array().cast("array<double>").alias("values"))
    return grams.unionByName(empty)


def config_grams(prepared, configs):
    """(config, i, values): one Gram matrix per config, summed from the cells' matrices."""
    cells = gram.gram_rows(gram.partial_grams(
        prepared.weights, prepared.rows, grid.CELL, gram.block_count(prepared.weights.count(), prepared.rows)), grid.CELL)
    per_config = gram.gram_rows(
        prepared.grid.to_configs(cells).where(F.col("config").isin(configs)), ["config"])
    return with_nothing(per_config, prepared.weights.sparkSession, configs)


def kernel_scores(prepared, configs, folds, alphas):
    """Fold errors of every config and alpha in one job; for few speakers, any vocabulary."""
    known = prepared.speakers.orderBy("i").collect()  # at most ridge.MAX_SIDE rows, checked
    predictions = gram.grid_predictions(
        config_grams(prepared, configs), [r["y"] for r in known], [r["fold"] for r in known],
        folds, alphas)
    keys = ["config", "alpha"]
    miss = F.col("y") - F.col("prediction")
    fold_errors = predictions.groupBy(*keys, "fit").agg(
        F.count("y").alias("n"), F.sum(miss * miss).alias("sse"),
        F.regr_syy("y", "y").alias("sst"), F.sum("seconds").alias("seconds"), F.min("error").alias("error"))
    fold_errors = materialise(fold_errors, "fold_errors")
    more = fold_errors.groupBy(*keys).agg(F.sum("seconds").alias("evaluation_time"), F.min("error").alias("error"))
    return ridge.cv_summary(fold_errors.where("error is null"), keys).join(more, keys, "right")


def wide_problem(prepared, configs, folds):
    """The packed matrix of some configs, one group each, and the numbers of the terms (ngram, term, t)."""
    has = [prepared.grid.has_cell(c) for c in configs]
    used = reduce(or_, has)
    names = materialise(row_index(prepared.frequencies.where(used).select(*grid.CELL, "term"), ["term", "ngram"], "t"), "terms")
    weights = prepared.weights.where(used)
    entries = terms.term_join(weights.select("i", "ngram", "term", "weight"), names.select("ngram", "term", "t"))
    square = F.col("weight") * F.col("weight")
    lengths = weights.groupBy("i").agg(*[F.sum(F.when(h, square)).alias(f"s{k}") for k, h in enumerate(has)])
    scale = F.array(*[F.coalesce(1 / F.nullif(F.sqrt(f"s{k}"), F.lit(0.0)), F.lit(0.0)) for k in range(len(has))])
    rows = prepared.speakers.join(lengths, "i", "left").select("i", "y", "fold", scale.alias("scale"))
    member = F.array(*[F.when(h, 1.0).otherwise(0.0) for h in has])
    return krylov.problem(materialise(entries.select("i", "t", "weight"), "entries"), rows,
                          names.select("t", member.alias("member")), folds, len(configs)), names


def wide_scores(prepared, configs, folds, alphas, at_once=8):
    """For any number of speakers and terms: some configs at a time, all their folds and alphas in one search.

    A search that fails is tried again config by config; what fails alone is a row with its error.
    """
    parts = []
    for k in range(0, len(configs), at_once):
        some = configs[k:k + at_once]
        started = time.time()
        try:
            own, _ = wide_problem(prepared, some, folds)
            found = krylov.solve(own, alphas)
            part = materialise(ridge.cv_summary(found.errors(), ["group", "alpha"]), "config_scores")
            lost = {pair: "ArithmeticError: no convergence" for pair in found.unsolved()}
        except Exception as error:  # one config's failure must not end the grid
            if len(some) > 1:
                parts.append(wide_scores(prepared, some, folds, alphas, 1))
                continue
            part = None
            lost = {(0, float(a)): f"{type(error).__name__}: {error}"[:500] for a in alphas}
        spent = (time.time() - started) / (len(some) * len(alphas))
        spark = prepared.weights.sparkSession
        points = spark.createDataFrame(
            [(c, g, float(a), lost.get((g, float(a))), spent) for g, c in enumerate(some) for a in alphas],
            "config int, group int, alpha double, error string, evaluation_time double")
        if part is None:
            nothing = [F.lit(None).cast("double").alias(c) for c in (
                "cv_r2_mean", "cv_r2_std", "cv_mse_mean", "cv_mse_std", "train_r2")]
            parts.append(points.select("*", *nothing).drop("group"))
        else:
            parts.append(points.join(part, ["group", "alpha"], "left").drop("group"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def failed(rows, size):
    """Sentinel values of a config that could not be evaluated."""
    return rows.select(
        "grid_pos", "min_df", "max_df", "ridge_alpha", "max_ngram",
        *[c for c in rows.columns if c == "max_features"], size.alias("vocab_size"),
        F.lit(-999.0).alias("cv_r2_mean"), F.lit(0.0).alias("cv_r2_std"),
        F.lit(999.0).alias("cv_mse_mean"), F.lit(0.0).alias("cv_mse_std"),
        F.lit(-999.0).alias("train_r2"), F.lit(0.0).alias("evaluation_time"),
        F.lit(False).alias("success"), "error")


def cross_validate(prepared, alphas=settings.ALPHAS, folds=settings.FOLDS,
                   min_vocab=settings.MIN_VOCAB):
    """One row per config and alpha, successes and failures, in grid order."""
    parameters = prepared.grid
    configs = materialise(
        parameters.vocabularies(prepared.frequencies, F.lit(prepared.ads), min_vocab), "configs")
    bad = parameters.with_alphas(configs.where("error is not null"), alphas).withColumn(
        "error", F.concat(F.lit("TF-IDF failure: "), "error"))
    good = configs.where("error is null")
    valid = [r["config"] for r in good.select("config").collect()]  # as long as the grid
    out = failed(bad, F.lit(0).cast("bigint"))
    points = parameters.with_alphas(good.drop("error"), alphas)
    if prepared.rows < folds:
        why = grid.SPLIT_ERROR % (folds, prepared.rows)
        scored = failed(points.withColumn("error", F.lit(why)), F.col("vocab_size"))
    elif not valid:
        scored = None
    else:
        route = kernel_scores if prepared.rows <= ridge.MAX_SIDE else wide_scores
        scores = route(prepared, valid, folds, alphas).withColumnRenamed("alpha", "ridge_alpha")
        scored = materialise(points.join(F.broadcast(scores), ["config", "ridge_alpha"]).drop("config"), "scored")
        broken = scored.where("error is not null").withColumn(
            "error", F.concat(F.lit("Ridge failure: "), "error"))
        scored = (scored.where("error is null").withColumn("success", F.lit(True))
                  .unionByName(failed(broken, F.col("vocab_size")), allowMissingColumns=True))
    if scored is not None:
        out = scored.unionByName(out, allowMissingColumns=True)
    limit = ["max_features"] if parameters.limited else []
    return out.select("grid_pos", *limit, *[F.col(f.name).cast(f.dataType) for f in CV_RESULTS])


def best_config(results):
    """The first of the configs with the highest mean R2."""
    known = F.col("cv_r2_mean").isNotNull() & ~F.isnan("cv_r2_mean")
    best = (results.where(F.col("success") & known).orderBy(F.desc("cv_r2_mean"), "grid_pos").limit(1)).first()
    if best is None:
        raise ValueError("no configuration succeeded")
    return best


def term_coefficients(weights, dual, key):
    """(ngram, term, coefficient): the rows' weights summed with their dual coefficients."""
    joined = lookup_join(weights, dual, key, "inner", spread=["ngram", "term"])
    return joined.groupBy("ngram", "term").agg(
        F.sum(F.col("weight") * F.col("coefficient")).alias("coefficient"))


def refit(prepared, best):
    """Weights by term on all speakers, for the best config."""
    config = prepared.grid.number(best["min_df"], best["max_df"], best["max_ngram"],
                                  best["max_features"] if prepared.grid.limited else None)
    mine = prepared.grid.has_cell(config)
    vocabulary = prepared.frequencies.where(mine).select(
        "ngram", "term", "df", terms.smoothed_idf(F.lit(prepared.ads)).alias("idf"))
    used = prepared.weights.where(mine)
    if prepared.rows <= ridge.MAX_SIDE:
        y = [r["y"] for r in prepared.speakers.orderBy("i").collect()]  # bounded as above
        parts = gram.partial_grams(
            used.withColumn("config", F.lit(config)), prepared.rows, ["config"],
            gram.block_count(used.count(), prepared.rows))
        dual = materialise(gram.dual_coefficients(
            with_nothing(gram.gram_rows(parts, ["config"]), used.sparkSession, [config]),
            y, best["ridge_alpha"]), "dual")
        summed = term_coefficients(used, dual, "i")
        intercept = dual.select("intercept").first()[0]
    else:
        own, names = wide_problem(prepared, [config], 0)
        found = krylov.solve(own, [best["ridge_alpha"]])
        if found.unsolved():
            raise ArithmeticError("the best point's fit on all speakers does not converge")
        summed = names.join(found.coefficients(0, best["ridge_alpha"]), "t").select("ngram", "term", "coefficient")
        intercept = found.intercept(0, best["ridge_alpha"])
    filled = vocabulary.join(summed, ["ngram", "term"], "left").na.fill(0.0, ["coefficient"])
    params = prepared.weights.sparkSession.range(1).select(
        F.lit(float(intercept)).alias("intercept"), F.lit(best["ridge_alpha"]).alias("ridge_alpha"),
        F.lit(best["min_df"]).alias("min_df"), F.lit(best["max_df"]).alias("max_df"),
        F.lit(best["max_ngram"]).alias("max_ngram"))
    return Model(materialise(filled, "model"), params)


def predict(model, units, key, order=None):
    """Score tokenised rows: one sum per key over its terms, the intercept where it has none."""
    settings_row = model.params.first()
    counts = terms.term_counts(units, key, order, settings_row["max_ngram"],
                               vocabulary=model.terms)
    joined = terms.term_join(counts, model.terms)
    weight = F.col("tf") * F.col("idf")
    sums = joined.groupBy(key).agg(
        (F.sum(weight * F.col("coefficient")) / F.sqrt(F.sum(weight * weight))).alias("part"))
    keys = units.where(F.col(key).isNotNull()).select(key).distinct()
    return keys.join(sums, key, "left").select(
        key, (F.coalesce("part", F.lit(0.0)) + settings_row["intercept"]).alias("prediction"))


def grid_search(ads, speeches, order=("speech_id",), min_df=settings.MIN_DF, max_df=settings.MAX_DF,
                max_ngram=settings.MAX_NGRAM, alphas=settings.ALPHAS, folds=settings.FOLDS,
                min_vocab=settings.MIN_VOCAB, key="unique_id", target="dime", score_order=None,
                max_features=(None,)):
    """Evaluate the grid, pick the best point, refit it on all speakers.

    `max_features` is a further axis: limits on the number of terms, None for no limit; the results then name it.

    `ads` needs an array column `tokens`; `speeches` needs `tokens`, `key`, `target` and the
    `order` columns, which together with the key are unique. A speaker's target is the first
    one in `score_order`, by default the same order.
    """
    require(ads, ["tokens"])
    require(speeches, ["tokens", key, target, *order, *(score_order or [])])
    prepared = prepare(ads, speeches, list(order), grid.Grid(min_df, max_df, max_ngram, max_features), folds,
                       key, target, score_order)
    results = materialise(cross_validate(prepared, alphas, folds, min_vocab), "cv_results")
    best = best_config(results)
    return Search(results, best, refit(prepared, best))
