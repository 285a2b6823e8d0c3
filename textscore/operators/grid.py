"""The parameter grid, and all its vocabularies from one document-frequency table.

The bounds of the grid cut the document frequencies into a few cells. Every config's
vocabulary is a union of cells, so terms are looked at once, not once per config. A limit on the number of
terms keeps a config's most frequent ones: all terms are put into one order by corpus frequency, each
config's last kept term is a place in it, and the places cut the order into bands, one more side of a cell.
"""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from textscore.operators.ordering import Ordered

CELL = ("above", "below", "ngram", "band")

# The texts that go into the `error` column.
BOUNDS_ERROR = "max_df corresponds to < documents than min_df"
EMPTY_ERROR = "After pruning, no terms remain. Try a lower min_df or a higher max_df."
SMALL_ERROR = "Vocabulary too small (size=%d < min_vocab=%d) for min_df=%d, max_df=%s"
SPLIT_ERROR = ("Cannot have number of splits n_splits=%d greater than the number of "
               "samples: n_samples=%d.")


class Grid:
    """min_df x max_df x ngram x max_features, in this order; `config` is the position.

    `max_features` None is no limit. With limits, `cells` must be called before configs are asked for.
    """

    def __init__(self, min_df, max_df, max_ngram, max_features=(None,)):
        self.min_df, self.max_df, self.max_ngram = list(min_df), list(max_df), list(max_ngram)
        self.max_features, self.last = list(max_features), {}

    @property
    def limited(self):
        return self.max_features != [None]

    def frame(self, spark):
        """One row per config: nested `posexplode` of the parameter lists."""
        def spread(df, name, values, kind):
            items = F.array([F.lit(v).cast(kind) for v in values])
            return df.select("*", F.posexplode(items).alias(f"_{name}", name))

        df = spark.range(1).drop("id")
        df = spread(df, "min_df", self.min_df, "int")
        df = spread(df, "max_df", self.max_df, "double")
        df = spread(df, "max_ngram", self.max_ngram, "int")
        df = spread(df, "max_features", self.max_features, "int")
        position = (((F.col("_min_df") * len(self.max_df) + F.col("_max_df"))
                     * len(self.max_ngram) + F.col("_max_ngram")) * len(self.max_features) + F.col("_max_features"))
        limit = ["max_features"] if self.limited else []
        return df.select(position.cast("int").alias("config"), "min_df", "max_df", "max_ngram", *limit)

    def with_alphas(self, configs, alphas):
        items = F.array([F.lit(float(a)) for a in alphas])
        df = configs.select("*", F.posexplode(items).alias("_alpha", "ridge_alpha"))
        return df.withColumn("grid_pos", F.col("config") * len(alphas) + F.col("_alpha")).drop("_alpha")

    def cells(self, frequencies, n):
        """Add the cell: how many lower bounds a term meets, how many upper ones, its length."""
        above = [(F.col("df") >= m).cast("int") for m in self.min_df]
        below = [(F.col("df") <= F.lit(float(s)) * n).cast("int") for s in self.max_df]
        rows = (frequencies.withColumns({"above": reduce(add, above), "below": reduce(add, below)})
                .where((F.col("above") > 0) & (F.col("below") > 0)
                       & (F.col("ngram") <= max(self.max_ngram))))
        if not self.limited:
            return rows.withColumn("band", F.lit(0))
        return self._banded(rows)

    def _banded(self, rows):
        """Add the band. `rows` need `cf`; equally frequent terms are ordered by spelling.

        The driver sees one row per config with a limit that is reached: its last kept term.
        """
        limits = [k for k in self.max_features if k is not None]
        bases = {}
        for config, (above, below, ngram) in enumerate(self._bounds()):
            bases.setdefault((above, below, ngram), []).append(config)
        member = {f"_in{j}": ((F.col("above") >= a) & (F.col("below") >= b) & (F.col("ngram") <= g)).cast("int")
                  for j, (a, b, g) in enumerate(bases)}
        ordered = Ordered(rows.withColumn("_rank", -F.col("cf")), ["_rank", "term", "ngram"], "ranks")
        ranked = ordered.running_sums(_place=F.lit(1), **member).result()
        last = F.array(*[F.when((F.col(name) == k) & (member[name] == 1), F.struct(F.lit(j).alias("j"), F.lit(k).alias("k")))
                         for j, name in enumerate(member) for k in limits])
        found = ranked.select("_place", F.explode(F.filter(last, lambda x: x.isNotNull())).alias("of")).collect()
        place = {(r["of"]["j"], r["of"]["k"]): r["_place"] for r in found}
        cuts = sorted(set(place.values()))
        for j, configs in enumerate(bases.values()):
            for config in configs:
                at = place.get((j, self.max_features[config % len(self.max_features)]))
                self.last[config] = len(cuts) if at is None else cuts.index(at)
        band = reduce(add, [(F.col("_place") > c).cast("int") for c in cuts], F.lit(0))
        return ranked.withColumn("band", band).drop("_rank", "_place", *member)

    def _bounds(self):
        """(above, below, ngram) of each config: the least cell numbers its terms have."""
        points = [(m, s, g) for m in self.min_df for s in self.max_df for g in self.max_ngram for _ in self.max_features]
        return [(sum(x <= m for x in self.min_df), sum(x >= s for x in self.max_df), g) for m, s, g in points]

    def _least(self):
        """(config, above, below, ngram, band): the bounds of a config's cells, the last two from above."""
        return [(c, a, b, g, self.last.get(c, 0)) for c, (a, b, g) in enumerate(self._bounds())]

    def number(self, min_df, max_df, max_ngram, max_features=None):
        """The config with these parameters."""
        base = ((self.min_df.index(min_df) * len(self.max_df) + self.max_df.index(max_df))
                * len(self.max_ngram) + self.max_ngram.index(max_ngram))
        return base * len(self.max_features) + self.max_features.index(max_features)

    def has_cell(self, config):
        """Whether a row's cell belongs to the config's vocabulary."""
        _, above, below, ngram, band = self._least()[config]
        return ((F.col("above") >= above) & (F.col("below") >= below) & (F.col("ngram") <= ngram)
                & (F.col("band") <= band))

    def to_configs(self, df):
        """Repeat rows that carry a cell for each config whose vocabulary has the cell."""
        least = ", ".join(f"named_struct('config', {c}, 'above', {a}, 'below', {b}, 'ngram', {g}, 'band', {d})"
                          for c, a, b, g, d in self._least())
        has = F.filter(F.expr(f"array({least})"), lambda c: (c["above"] <= F.col("above"))
                       & (c["below"] <= F.col("below")) & (c["ngram"] >= F.col("ngram")) & (c["band"] >= F.col("band")))
        return df.withColumn("config", F.explode(F.transform(has, lambda c: c["config"])))

    def vocabularies(self, cell_rows, n, min_vocab):
        """Per config the vocabulary size, and why it fails if it does.

        `cell_rows` are terms with their cell. They are counted per cell first, at most
        (lower bounds x upper bounds x lengths) rows.
        """
        sizes = (self.to_configs(cell_rows.groupBy(*CELL).agg(F.count("*").alias("terms")))
                 .groupBy("config").agg(F.sum("terms").alias("terms")))
        df = self.frame(cell_rows.sparkSession).join(F.broadcast(sizes), "config", "left")
        size = F.coalesce("terms", F.lit(0)).cast("bigint")
        small = F.format_string(SMALL_ERROR, size, F.lit(min_vocab), F.col("min_df"),
                                F.col("max_df").cast("string"))
        error = (F.when(F.col("max_df") * n < F.col("min_df"), BOUNDS_ERROR)
                 .when(size == 0, EMPTY_ERROR).when(size < min_vocab, small))
        limit = ["max_features"] if self.limited else []
        return df.select("config", "min_df", "max_df", "max_ngram", *limit, size.alias("vocab_size"),
                         error.alias("error"))
