"""Counts, summaries and the search report, as DataFrames."""

from pyspark.sql import functions as F

from textscore.operators.quantile import histogram, histogram_quantiles


def summary(df, entity, score="dime"):
    """Rows, distinct entities and mean score of a cleaned table."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("entities"),
                  F.avg(score).alias("mean_score"))


def token_stats(df, column="token_count"):
    """Rows, mean, median, min and max of a token count, all from one pass."""
    counts = histogram(df, column)
    return counts.agg(
        F.sum("n").alias("rows"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean_tokens"),
        F.min("v").cast("int").alias("min_tokens"), F.max("v").cast("int").alias("max_tokens"),
    ).withColumn("median_tokens", histogram_quantiles(counts, [0.5]).scalar())


def totals(results):
    return results.agg(
        F.count("*").alias("tested"), F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"))


def top(results, k=5):
    """The k best successful points; on equal R2 the earlier one."""
    return results.where("success").orderBy(F.desc("cv_r2_mean"), "grid_pos").limit(k)


def breakdowns(results):
    """Mean and best R2 by min_df, by max_df and by alpha, in one pass.

    The mean vocabulary is given for the two vocabulary bounds only.
    """
    good = results.where("success")
    sets = [["min_df"], ["max_df"], ["ridge_alpha"]]
    grouped = good.groupingSets(sets, "min_df", "max_df", "ridge_alpha").agg(
        F.avg("cv_r2_mean").alias("mean_r2"), F.max("cv_r2_mean").alias("max_r2"),
        F.avg("vocab_size").alias("vocab"), F.count("*").alias("combos"),
        F.grouping_id().alias("which"))
    parameter = (F.when(F.col("which") == 3, "min_df").when(F.col("which") == 5, "max_df")
                 .otherwise("ridge_alpha"))
    value = F.coalesce(F.col("min_df").cast("double"), "max_df", "ridge_alpha")
    return grouped.select(
        parameter.alias("parameter"), value.alias("value"), "mean_r2", "max_r2",
        F.when(parameter != "ridge_alpha", F.col("vocab")).alias("mean_vocab"),
        "combos").orderBy("parameter", "value")


def report(results):
    return {"totals": totals(results), "top": top(results), "breakdowns": breakdowns(results)}
