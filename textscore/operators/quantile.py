"""Exact interpolated quantiles from a distributed histogram."""

from pyspark.sql import functions as F

from textscore.operators.ordering import Ordered
from textscore.sources.work import materialise


def histogram(df, column):
    """(v, n): distinct values and how often they occur, NULL and NaN left out.

    Equal values are counted map-side. The table is written: it is read several times, the
    rows behind it once. Missing values are left out only then, as a filter on the value
    would be pushed down and compute a derived column twice.
    """
    counted = df.select(F.col(column).cast("double").alias("v")).groupBy("v").agg(
        F.count("*").alias("n"))
    return materialise(counted, "histogram").where("v is not null and not isnan(v)")


def histogram_quantiles(values, shares):
    """One row, columns `q0`, `q1`, ...: quantiles by linear interpolation.

    The values are sliced by range and their counts summed along the slices, so that neither
    one task nor one buffer has to hold them all. Few or many values take the same way.
    """
    cumulated = Ordered(values, ["v"], "values").running("upto", F.col("n")).result()
    total = values.agg(F.sum("n")).scalar()
    picks = []
    for k, share in enumerate(shares):
        rank = (total - 1) * F.lit(float(share))
        picks += [
            F.min(F.when(F.col("upto") > F.floor(rank), F.col("v"))).alias(f"lo{k}"),
            F.min(F.when(F.col("upto") > F.ceil(rank), F.col("v"))).alias(f"hi{k}"),
            F.max(rank - F.floor(rank)).alias(f"w{k}"),
        ]
    row = cumulated.agg(*picks)
    return row.select(*[
        (F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"w{k}")).alias(f"q{k}")
        for k in range(len(shares))])


def exact_quantiles(df, column, shares):
    return histogram_quantiles(histogram(df, column), shares)


def above_quantile(df, column, share):
    """Rows strictly above the quantile of the rows given."""
    cut = exact_quantiles(df, column, [share]).scalar()
    return df.where(F.col(column) > cut)
