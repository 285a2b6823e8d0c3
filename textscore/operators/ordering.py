"""Row numbers, running sums and neighbours over a total order, without a global window.

The rows are range-partitioned on the order columns into contiguous slices. As the order
is total, Spark may cut inside a hot group, so slices stay balanced however the groups are
spread. Windows run inside a slice; what earlier slices contribute comes from a table with
one row per slice.
"""

from functools import reduce
from operator import add

from pyspark.sql import Window
from pyspark.sql import functions as F

from textscore.sources.work import materialise

SLICE = "_slice"


class Ordered:
    """`df` cut into slices along `order`, whose values must be unique per row."""

    def __init__(self, df, order, name="ordered"):
        self.order = list(order)
        # The slice number must not change between reads, so it is written down.
        self.df = materialise(
            df.repartitionByRange(*self.order).withColumn(SLICE, F.spark_partition_id()), name)

    def _within(self):
        return Window.partitionBy(SLICE).orderBy(*self.order)

    def _carried(self, per_slice, columns):
        """Join one row per slice; slices number at most the shuffle partitions."""
        self.df = self.df.join(F.broadcast(per_slice), SLICE, "left")
        return [F.col(c) for c in columns]

    def running(self, name, value, fn="sum"):
        """Add `name`: the sum or max of `value` over all rows up to and including this one."""
        aggregate = {"sum": F.sum, "max": F.max}[fn]
        earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carry = (self.df.groupBy(SLICE).agg(aggregate(value).alias("_part"))
                 .select(SLICE, aggregate("_part").over(earlier).alias("_carry")))
        upto = self._within().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = aggregate(value).over(upto)
        (before,) = self._carried(carry, ["_carry"])
        if fn == "sum":
            total = F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
        else:
            total = F.greatest(before, local)
        self.df = self.df.withColumn(name, total).drop("_carry")
        return self

    def running_sums(self, **values):
        """Add several running sums at once: one pass for the slices' totals, one window."""
        earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        parts = self.df.groupBy(SLICE).agg(*[F.sum(v).alias(f"_of_{n}") for n, v in values.items()])
        carry = parts.select(SLICE, *[F.sum(f"_of_{n}").over(earlier).alias(f"_of_{n}") for n in values])
        self._carried(carry, [])
        upto = self._within().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        names = [c for c in self.df.columns if not c.startswith("_of_")]
        self.df = self.df.select(*names, *[(F.coalesce(F.col(f"_of_{n}"), F.lit(0)) + F.sum(v).over(upto)).alias(n)
                                           for n, v in values.items()])
        return self

    def previous(self, name, value):
        """Add `name`: `value` of the row just before this one, NULL for the first."""
        last = (self.df.groupBy(SLICE)
                .agg(F.max_by(F.struct(value.alias("v")), F.struct(*self.order)).alias("_last"))
                .select(SLICE, F.lag("_last").over(Window.orderBy(SLICE)).alias("_carry")))
        local = F.lag(F.struct(value.alias("v"))).over(self._within())
        (before,) = self._carried(last, ["_carry"])
        self.df = self.df.withColumn(name, F.coalesce(local, before)["v"]).drop("_carry")
        return self

    def result(self):
        return self.df.drop(SLICE)


def row_index(df, order, name="row_index"):
    """Zero-based position of every row in the total order."""
    ordered = Ordered(df, order, "rows").running(name, F.lit(1).cast("bigint"))
    return ordered.result().withColumn(name, F.col(name) - 1)


def fold_starts(n, k):
    """Positions at which the k folds of n rows start; the first `n mod k` are one row longer."""
    return [f * (n // k) + min(f, n % k) for f in range(k)]


def _reached(reached):
    return reduce(add, [r.cast("int") for r in reached], F.lit(0))


def folds_of_index(index, n, k):
    """Fold of a row by its position among n."""
    return _reached([F.col(index) >= start for start in fold_starts(n, k)[1:]])


def contiguous_folds(df, order, k, name="fold"):
    """Unshuffled k-fold: k runs of the order, whose columns must be unique and not NULL.

    Only the order columns are sorted, to find the k - 1 rows at which a fold starts; the
    table itself is then compared with these and not moved.
    """
    indexed = row_index(df.select(*order), order, "_index")
    starts = fold_starts(indexed.count(), k)[1:]
    borders = indexed.where(F.col("_index").isin(starts)).orderBy("_index").collect()  # k - 1 rows
    key = F.struct(*order)
    reached = [key >= F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in order])
               for row in borders]
    return df.withColumn(name, _reached(reached))
