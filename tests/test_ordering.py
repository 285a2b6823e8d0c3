import random

import pytest
from pyspark.sql import functions as F

from textscore.operators.ordering import SLICE, Ordered, contiguous_folds, folds_of_index, row_index


@pytest.mark.parametrize("n,k,sizes", [(12, 5, [3, 3, 2, 2, 2]), (13, 5, [3, 3, 3, 2, 2]),
                                       (3, 5, [1, 1, 1]), (10, 2, [5, 5])])
def test_fold_sizes_and_order(spark, n, k, sizes):
    names = [f"k{i:03}" for i in range(n)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(x,) for x in names], "key string")
    got = contiguous_folds(df, ["key"], k).orderBy("key").collect()
    indexed = row_index(df, ["key"], "i").orderBy("key").collect()
    assert [r["i"] for r in indexed] == list(range(n))
    by_index = row_index(df, ["key"], "i").select("key", folds_of_index("i", n, k).alias("fold"))
    assert by_index.orderBy("key").collect() == got
    assert [r["fold"] for r in got] == [f for f, size in enumerate(sizes) for _ in range(size)]


def test_scans_cross_slices(spark):
    """Index, running sum and neighbour against a plain loop, one key holding most rows."""
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, rng.randrange(9))
            for i in range(2000)]
    df = spark.createDataFrame(data, "k string, i int, v int").repartition(7, "i")
    ordered = Ordered(df, ["k", "i"])
    ordered.running("total", F.col("v")).previous("before", F.col("v"))
    ordered.running("peak", F.when(F.col("v") > 7, F.col("i")), "max")
    assert ordered.df.select(SLICE).distinct().count() > 1
    got = ordered.result().orderBy("k", "i").collect()
    total, peak, before = 0, None, None
    for (_, i, v), row in zip(sorted(data), got):
        total += v
        if v > 7:
            peak = i if peak is None else max(peak, i)
        assert (row["v"], row["total"], row["before"], row["peak"]) == (v, total, before, peak)
        before = v


def test_slices_split_a_hot_key(spark):
    df = spark.range(4000).withColumn("k", F.lit("one"))
    counts = [r["count"] for r in Ordered(df, ["k", "id"]).df.groupBy(SLICE).count().collect()]
    assert len(counts) > 2 and max(counts) < 2000


def test_row_index_of_nothing(spark):
    df = spark.createDataFrame([], "key string")
    assert row_index(df, ["key"]).count() == 0
    assert contiguous_folds(df, ["key"], 5).count() == 0
