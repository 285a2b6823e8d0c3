"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Statistics of each text become sketches per (lang, source): counts of logarithmic buckets (relative
error `ACCURACY`), which merge by addition, in any order and with equal results, so Spark sums
them map-side and a hot source is no burden. A statistic's upper threshold is
`q75 + spread x max(q75 - q25, least)`, its lower one the mirror image; `least` is a fixed least
width. A language's sketch is the sum of its groups'. Each sketch is merged with the one above it, scaled down to
`prior` texts: a group's with its language's, a language's with that of all texts. So every group has thresholds
of its own, a small one leans on its language and a large one hardly does, without a switch at any size.
Thresholds join the texts and filter them.

Defined results: null texts are empty ones: no words, every count 0, base_failed, not kept. Null
lang or source is a value of its own. A text that equals a threshold is within it. Rows equal in all columns
get equal results. Empty tables give empty results. Extra columns stay; one named like a
result column is replaced.
"""

import math

import numpy as np

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textscore.llm.text import SPACE, Words, combine, mix, over_texts, without
from textscore.operators.joins import lookup_join
from textscore.sources.work import materialise

ACCURACY = 0.01
_LOG_STEP = math.log((1 + ACCURACY) / (1 - ACCURACY))
_SMALLEST = 1e-6
#: Statistic: (sides that have a threshold, least width of the quartile range).
STATISTICS = {"symbol_share": ("above", 0.02), "bang_share": ("above", 0.02),
              "upper_share": ("above", 0.05), "word_length": ("both", 0.5),
              "repeat_share": ("above", 0.05), "dup_line_share": ("above", 0.05)}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs")


def repeated_words(words, count, width=8):
    """Per text, its words inside windows of `width` words that it has at least twice."""
    windows = combine(words.hash, width)
    covered = np.zeros(len(words.hash) + 1, np.int64)
    if len(windows):
        at = np.flatnonzero(words.text[:len(windows)] == words.text[width - 1:])
        keys = windows[at] ^ mix(words.text[at].astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + width, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return np.bincount(words.text[inside], minlength=count).astype(np.int64)


def repeated_lines(text):
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def count_texts(texts):
    """The counts of each text, as arrays by name."""
    words = Words(texts, lower=False)
    data, begin = words.data, words.offset[:-1]
    # Every text is followed by a line break, so each run of bytes is non-empty.
    per = lambda flag: np.add.reduceat(flag.astype(np.int64), begin)
    return {"n_words": words.count.astype(np.int64),
            "word_chars": per(~SPACE[data] & ((data & 0xC0) != 0x80)),
            "n_symbols": per(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))),
            "n_dup_lines": np.array([repeated_lines(t) for t in texts], np.int64),
            "n_repeat_words": repeated_words(words, len(texts)),
            "n_upper": per((data >= 65) & (data <= 90)), "n_bangs": per(data == 33)}


def statistics(rows):
    """`rows` of counts with the shares that get thresholds."""
    over = lambda n, d: F.col(n) / F.greatest(F.col(d), F.lit(1))
    return rows.withColumns({
        "symbol_share": over("n_symbols", "word_chars"), "bang_share": over("n_bangs", "n_words"),
        "upper_share": over("n_upper", "word_chars"), "word_length": over("word_chars", "n_words"),
        "repeat_share": over("n_repeat_words", "n_words"),
        "dup_line_share": over("n_dup_lines", "n_words")})


def sketches(rows, keys):
    """(keys, name, bucket, n): one mergeable sketch per group and statistic."""
    named = F.explode(F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).alias("x"))
                                for s in STATISTICS])).alias("v")
    bucket = F.when(F.col("v.x") > _SMALLEST, F.ceil(F.log(F.col("v.x")) / _LOG_STEP)).cast("int")
    return (rows.select(*keys, named)
            .select(*keys, "v.name", F.coalesce(bucket, F.lit(-(1 << 20))).alias("bucket"))
            .groupBy(*keys, "name", "bucket").agg(F.count("*").alias("n")))


def merge(sketch, keys):
    return sketch.groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n"))


def lean(sketch, above, keys, shared, prior):
    """`sketch` merged with `above`, whose counts are scaled to `prior` texts; `shared` are the keys of `above`."""
    total = above.groupBy(*shared, "name").agg(F.sum("n").alias("total"))
    share = lookup_join(above, total, [*shared, "name"], spread=["bucket"])
    share = share.select(*shared, "name", F.col("bucket").alias("b"), (F.col("n") * prior / F.col("total")).alias("part"))
    groups = sketch.select(*keys, "name").distinct()
    scaled = (lookup_join(groups, share, [*shared, "name"], spread=keys)
              .select(*keys, "name", F.col("b").alias("bucket"), F.col("part").alias("n")))
    return (sketch.select(*keys, "name", "bucket", F.col("n").cast("double").alias("n")).unionByName(scaled)
            .groupBy(*keys, "name", "bucket").agg(F.sum("n").alias("n")))


def thresholds(sketch, keys, spread=3.0):
    """(keys, low_*, high_*) from the quartiles of sketches."""
    group = Window.partitionBy(*keys, "name")
    running = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (sketch.withColumn("upto", F.sum("n").over(running))
              .withColumn("texts", F.max("upto").over(group)))

    def quantile(q):                    # sums of shares may differ in their last digits
        bucket = F.min(F.when(F.col("upto") >= (q - 1e-9) * F.col("texts"), F.col("bucket")))
        return F.when(bucket <= -(1 << 20), 0.0).otherwise(
            F.exp(bucket * _LOG_STEP) * (2 / (1 + math.exp(_LOG_STEP))))

    quartiles = ranked.groupBy(*keys, "name").agg(
        quantile(0.25).alias("q25"), quantile(0.75).alias("q75"))
    columns = []
    for name, (sides, least) in STATISTICS.items():
        own = lambda e: F.max(F.when(F.col("name") == name, e))
        width = spread * F.greatest(F.col("q75") - F.col("q25"), F.lit(least))
        low = F.lit(None).cast("double") if sides == "above" else own(F.col("q25") - width)
        columns += [low.alias(f"low_{name}"), own(F.col("q75") + width).alias(f"high_{name}")]
    return quartiles.groupBy(*keys).agg(*columns)


def group_thresholds(rows, prior=20, spread=3.0):
    """(_lang, _source, low_*, high_*) of each group."""
    keys = ["_lang", "_source"]
    fine = materialise(sketches(rows, keys), "sketches")
    middle = merge(fine, ["_lang"])
    middle = materialise(lean(middle, merge(middle, []), ["_lang"], [], prior), "language-sketches")
    return thresholds(lean(fine, middle, keys, ["_lang"], prior), keys, spread)


def judge(docs, text="text", lang="lang", source="source", prior=20, spread=3.0,
          min_words=20, max_repeated=30):
    """`docs` without the text, with the counts, `base_failed` and `kept`."""
    docs = without(docs, *COUNTS, *STATISTICS, "base_failed", "kept", "_lang", "_source")
    named = lambda c: F.when(F.col(f"`{c}`").isNull(), F.lit("")).otherwise(
        F.concat(F.lit("="), F.col(f"`{c}`").cast("string")))
    kept = [c for c in docs.columns if c != text]
    rows = over_texts(docs, text, ", ".join(f"{c} long" for c in COUNTS), count_texts, kept)
    rows = materialise(rows.withColumns({"_lang": named(lang), "_source": named(source)}), "counts")
    rows = statistics(rows)
    found = group_thresholds(rows, prior, spread)
    failed = ((F.col("n_words") < min_words)
              | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words")))
    within = F.lit(True)
    for name in STATISTICS:
        within &= ~F.coalesce(F.col(name) < F.col(f"low_{name}"), F.lit(False))
        within &= ~F.coalesce(F.col(name) > F.col(f"high_{name}"), F.lit(False))
    spread_by = [c for c in kept if c not in (lang, source)] or list(COUNTS)
    return (lookup_join(rows, found, ["_lang", "_source"], spread=spread_by)
            .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & within)
            .select(*kept, *COUNTS, "base_failed", "kept"))
