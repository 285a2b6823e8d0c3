"""Connected components of links, by alternating stars, as joins and minima."""

from pyspark.sql import functions as F

from textscore.sources.work import materialise


def _large_star(edges):
    """Every larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b"))


def _small_star(edges):
    """u and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _mark(edges):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links):
    """(id, component): the least id reachable, for each end of the links (a, b) other than it."""
    edges = materialise(links.filter("a <> b").select("a", "b"), "edges")
    before = None
    while True:
        edges = materialise(_small_star(_large_star(edges)), "stars")
        now = _mark(edges)
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before = now
