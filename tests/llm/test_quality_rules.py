import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from textscore.llm import quality_rules as qr
from tests.llm.helpers import docs, empty, odd_docs, prose, words


def brute(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for k in range(len(w) - 7):
        places.setdefault(tuple(w[k:k + 8]), []).append(k)
    covered = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(spark):
    texts = ["", None, "a " * 30, " ".join(words(9, 1)) + " x " + " ".join(words(9, 1)), "é # | < ü\nx\n\nx\n x\nx ",
             "one two three four five six seven eight " * 2, prose(900, 3), "a\tb\x0bc\x0cd\re\x1cf\xa0g h",
             " ".join(words(4000, 5, 30))]
    found = {r["doc_id"]: r for r in qr.judge(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), i
        assert r["base_failed"] == (brute(t)[0] < 20 or 100 * brute(t)[4] > 30 * brute(t)[0])
        assert not (r["base_failed"] and r["kept"])


def brute_verdicts(rows, prior=20, spread=3.0):
    """doc_id -> kept of (id, text, lang, source, ...) rows, in one process."""
    step = math.log((1 + qr.ACCURACY) / (1 - qr.ACCURACY))
    shares = {}
    for i, text, *_ in rows:
        n, chars, symbols, lines, repeats = brute(text)
        upper, bangs = sum("A" <= c <= "Z" for c in text), text.count("!")
        shares[i] = {"symbol_share": symbols / max(chars, 1), "bang_share": bangs / max(n, 1),
                     "upper_share": upper / max(chars, 1), "word_length": chars / max(n, 1),
                     "repeat_share": repeats / max(n, 1), "dup_line_share": lines / max(n, 1)}
    kept = {}
    for i, text, lang, source, *_ in rows:
        n, *_, repeats = brute(text)
        ok = n >= 20 and 100 * repeats <= 30 * n
        for name, (sides, least) in qr.STATISTICS.items():
            bucket = lambda x: math.ceil(math.log(x) / step) if x > 1e-6 else -(1 << 20)
            sketch = lambda test: Counter(bucket(shares[x[0]][name]) for x in rows if test(x))
            merged = sketch(lambda x: True)
            for test in (lambda x: x[2] == lang, lambda x: x[2:4] == (lang, source)):
                own, total = sketch(test), sum(merged.values())
                merged = {b: own.get(b, 0) + merged[b] * prior / total for b in sorted(merged)}

            def quantile(q):
                upto, whole = 0.0, sum(merged.values())
                for b in sorted(merged):
                    upto += merged[b]
                    if upto >= (q - 1e-9) * whole:
                        return 0.0 if b == -(1 << 20) else math.exp(b * step) * 2 / (1 + math.exp(step))

            low, high = quantile(0.25), quantile(0.75)
            width, value = spread * max(high - low, least), shares[i][name]
            ok &= value <= high + width and (sides == "above" or value >= low - width)
        kept[i] = ok
    return kept


def test_odd_rows(spark):
    rows = qr.judge(odd_docs(spark)).collect()
    assert len(rows) == 10 and {"score", "spans"} <= set(rows[0].asDict())
    assert [r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 7)] == [False] * 4
    assert qr.judge(empty(spark)).collect() == []


def test_thresholds_follow_the_group(spark):
    """What is usual in one source is an outlier in another."""
    tables = [(i, " | ".join(words(60, i)), "en", "tables", 0) for i in range(120)]
    plain = [(1000 + i, " ".join(words(60, 500 + i)), "en", "prose", 0) for i in range(120)]
    odd = [(5000, " | ".join(words(60, 9999)), "en", "prose", 0)]
    df = spark.createDataFrame(tables + plain + odd, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["kept"] for r in qr.judge(df).collect()}
    assert all(kept[i] for i in range(120)) and all(kept[1000 + i] for i in range(120)) and not kept[5000]


def test_verdicts_against_brute_force(spark):
    """Groups of 1 to 150 texts: sketches, their leaning on the language and on all, quartiles and verdicts."""
    r, rows = random.Random(8), []
    for g, (lang, source, n, rate) in enumerate([("en", "a", 150, 0.0), ("en", "b", 60, 0.3), ("en", "c", 3, 0.5),
                                                 ("de", "a", 12, 0.1), (None, "d", 1, 0.0), ("de", None, 25, 0.02)]):
        for i in range(n):
            own = rate if r.random() < 0.9 else r.random()
            text = " ".join(w + ("|" if r.random() < own else "!" if r.random() < own / 3 else "")
                            for w in words(r.randrange(15, 60), 1000 * g + i))
            rows.append((len(rows), text, lang, source, len(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    expected = brute_verdicts(rows)
    assert {x["doc_id"]: x["kept"] for x in qr.judge(df).collect()} == expected
    failed = [i for i, t, *_ in rows if brute(t)[0] < 20]
    assert 0 < len(failed) < sum(not k for k in expected.values()) < len(rows)


def test_sketches_merge_to_the_sketch_of_the_whole(spark):
    counts = spark.range(500).select((F.col("id") % 7).alias("g"), *[
        (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(90))).cast("long").alias(c) for c in qr.COUNTS])
    rows = qr.statistics(counts)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(qr.merge(qr.sketches(rows, ["g"]), []).select("name", "bucket", "n")) == \
        key(qr.sketches(rows, []).select("name", "bucket", "n"))


def test_quantiles_are_within_the_accuracy(spark):
    rows = spark.range(1, 2001).select(*[F.lit(0.0).alias(s) for s in qr.STATISTICS if s != "word_length"],
                                       (F.col("id") / 10).alias("word_length"), F.lit(0).alias("g"))
    high = qr.thresholds(qr.sketches(rows, ["g"]), ["g"], spread=0.0).first()["high_word_length"]
    assert abs(high - 150) <= 150 * 2 * qr.ACCURACY
