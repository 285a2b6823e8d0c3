"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, at least `least` words and `times` periods long,
that no neighbouring word extends. For each power of two m, every factor of m words that occurs again in its
text gets a number (from the numbers of its two halves, so unrepeated factors drop out and a level costs
only what still repeats). If successive occurrences of a factor are d, and again d words apart, d <= 2m, this
arithmetic progression proposes the period d. Every run of four periods or more is proposed: with q <= m < 2q
a factor of m words at its start occurs again after q and 2q words and, as it is no shorter than the
period, nowhere between. A proposal is extended to both sides by comparing factors from the longest
level down, which costs one look per level, and equal runs are merged.

A word is dropped if a run holds it after the run's first period; what stays is the collapsed text.

All texts of a slice are treated at once in a task, words of different texts having different numbers. A text
is never cut; memory is a few numbers per word and level. Nothing is shuffled.

Defined results: a null or empty text has no words, no runs and an empty collapsed text. Repeated rows
get the same result each. Extra columns stay out, whatever their names. Words are compared as they are
written, by 64-bit hashes.
"""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textscore.llm.text import Words, mix, over_texts

RUNS = "array<struct<start:long,length:long,period:long>>"


def _named(key, at, size):
    """(names, next): numbers of the keys that repeat, -1 elsewhere, and the next place with the same key."""
    names, after = np.full(size, -1, np.int32), np.full(size, -1, np.int64)
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    number = np.cumsum(np.concatenate([[True], ~same])) if len(key) else np.zeros(0, np.int64)
    names[at[again]] = number[again]
    after[at[:-1][same]] = at[1:][same]
    return names, after


def factor_levels(hashes, text):
    """(names, next) of each level: of the factors of 1, 2, 4, ... words that repeat within their text."""
    size, step, levels = len(hashes), 1, []
    key = hashes ^ mix(text.astype(np.uint64) + np.uint64(1))
    names, after = _named(key, np.arange(size), size)
    while (names >= 0).any():
        levels.append((names, after))
        at = np.flatnonzero(names[:max(size - step, 0)] >= 0)
        at = at[(names[at + step] >= 0) & (text[at] == text[at + step])]
        key = names[at].astype(np.int64) * (size + 1) + names[at + step]
        names, after = _named(key, at, size)
        step *= 2
    return levels


def proposals(levels):
    """(place, period) from the progressions of each level, the first place of consecutive ones."""
    found = []
    for k, (_, after) in enumerate(levels):
        i = np.flatnonzero(after >= 0)
        d = after[i] - i
        then = after[after[i]]
        ok = (d <= 2 << k) & (then >= 0) & (then - after[i] == d)
        i, d = i[ok], d[ok]
        order = np.lexsort((i, d))
        i, d = i[order], d[order]
        new = np.ones(len(i), bool)
        new[1:] = (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1])
        found.append(np.stack([i[new], d[new]]))
    return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)


def extended(levels, i, d):
    """(start, end) of the longest stretches with period d around the places i."""
    size = len(levels[0][0])
    left, right = i.copy(), i + d
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k][0], 1 << k
        at = np.minimum(right, size - 1)
        same = (right < size) & (names[at] >= 0) & (names[at] == names[np.maximum(at - d, 0)])
        right = right + np.where(same, step, 0)
        at = np.maximum(left - step, 0)
        same = (left >= step) & (names[at] >= 0) & (names[at] == names[np.minimum(at + d, size - 1)])
        left = left - np.where(same, step, 0)
    return left, right


def find_runs(hashes, text, least=6, times=4):
    """(start, length, period) of all runs, by start and period; `text` numbers the text of each word."""
    levels = factor_levels(hashes, text)
    if not levels:
        return (np.zeros(0, np.int64),) * 3
    i, d = proposals(levels)
    start, end = extended(levels, i, d)
    length = end - start
    ok = length >= np.maximum(least, times * d)
    runs = np.unique(np.stack([start[ok], d[ok], length[ok]]), axis=1)
    return runs[0], runs[2], runs[1]


def detect_runs(docs, text="text", key="doc_id", least=6, times=4):
    """(key, n_words, runs, collapsed) per row of `docs`; `runs` is sorted by start, then period."""
    if times < 4:
        raise ValueError("runs shorter than four periods are not all proposed")

    def work(texts):
        words = Words(texts, lower=False)
        start, length, period = find_runs(words.hash, words.text, least, times)
        drop = np.zeros(len(words.text) + 1, np.int64)
        np.add.at(drop, start + period, 1)
        np.add.at(drop, start + length, -1)
        kept = np.cumsum(drop)[:-1] == 0
        owner = words.text[start]
        first = words.first[:-1]
        collapsed = []
        for t, value in enumerate(texts):
            own = value.split()
            stays = kept[first[t]:first[t] + words.count[t]]
            if not stays.all():
                own = [own[p] for p in np.flatnonzero(stays)]
            collapsed.append(b" ".join(own))
        values = pa.StructArray.from_arrays(
            [pa.array(start - first[owner]), pa.array(length), pa.array(period)], ["start", "length", "period"])
        edges = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
        return {"n_words": pa.array(words.count.astype(np.int64)),
                "runs": pa.ListArray.from_arrays(pa.array(edges), values),
                "collapsed": pa.array(collapsed, pa.binary()).cast(pa.string())}

    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_text"))
    return over_texts(rows, "_text", f"n_words long, runs {RUNS}, collapsed string", work, keep=(key,))


def longest(runs):
    """The longest run of a list as a struct: ties by start, then period; null without runs."""
    best = F.array_min(F.transform(runs, lambda r: F.struct(
        (-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.when(best.isNotNull(), F.struct(
        best["start"].alias("start"), (-best["length"]).alias("length"), best["period"].alias("period")))


def listing(runs):
    """Every run as `start,length,period` and a line feed."""
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def with_cycles(docs, text="text", key="doc_id"):
    """`docs` with a cycle written into every tenth text: from word a on, p words are repeated to the end.

    Which texts, a and p follow from the crc32 of the key. Texts without words and null keys stay.
    """
    h = F.crc32(F.col(f"`{key}`").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(f"`{text}`"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("_words")
    a = F.when(n > 0, g % n).otherwise(0).cast("int")
    tail = n - F.col("_a")
    p = (1 + F.floor(tail / (3 + g % 8))).cast("int")
    cycle = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    filled = F.slice(F.flatten(F.array_repeat(cycle, F.ceil(tail / F.col("_p")).cast("int"))), F.lit(1), tail)
    written = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), filled), " ")
    rows = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_own"),
                       F.when(h % 10 == 0, words).alias("_words"))
    rows = rows.withColumn("_a", a).withColumn("_p", p)
    return rows.select(key, F.when(n > 0, written).otherwise(F.col("_own")).alias(text))
