import hashlib
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.llm.helpers import docs, empty, odd_docs
from textscore.llm import periodic_runs as pr
from textscore.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words, least=6, times=4):
    """All runs by trying every period."""
    n, found = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i:
                stretch = words[i:j + q]
                smaller = any(all(stretch[x] == stretch[x + p] for x in range(len(stretch) - p)) for p in range(1, q))
                if len(stretch) >= max(least, times * q) and not smaller:
                    found.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def samples():
    r = random.Random(4)
    out = [["a"] * 5, ["a"] * 6, ["a"] * 50, list("abababab"), list("ababababa"), list("abababa"), list("aabaabaabaab") + ["b"]]
    for k in range(150):
        words = [r.choice("ab" if k % 2 else "abcde") for _ in range(r.randrange(1, 60))]
        for _ in range(r.randrange(3)):
            cycle = [r.choice("abcxyz") for _ in range(r.randrange(1, 9))]
            at = r.randrange(len(words) + 1)
            words[at:at] = (cycle * 9)[:r.randrange(1, 9 * len(cycle) + 1)]
        out.append(words)
    return out


def test_runs_equal_brute_force(spark):
    texts = samples()
    got = {r["doc_id"]: r for r in pr.detect_runs(docs(spark, [" ".join(t) for t in texts])).collect()}
    for i, words in enumerate(texts):
        want = brute(words)
        assert [tuple(x) for x in got[i]["runs"]] == want, words
        assert got[i]["collapsed"] == collapse(words, want)
        assert got[i]["n_words"] == len(words)


def test_long_cycles_and_texts_beside_each_other():
    """Runs end at the border of a text, also where the next one goes on in the same way."""
    cycle = [f"w{k}" for k in range(700)]
    words = np.array([hash(w) & 0xFFFFFFFF for w in cycle * 5 + cycle * 4 + ["z"] * 7], np.uint64)
    text = np.repeat([0, 1, 2], [3500, 2800, 7])
    runs = list(zip(*(x.tolist() for x in pr.find_runs(words, text))))
    assert runs == [(0, 3500, 700), (3500, 2800, 700), (6300, 7, 1)]


def test_names_are_kept_for_repeated_factors_only():
    text = np.zeros(8, np.int64)
    words = np.array([1, 2, 3, 1, 2, 9, 8, 7], np.uint64)
    levels = pr.factor_levels(words, text)
    assert [np.flatnonzero(n >= 0).tolist() for n, _ in levels] == [[0, 1, 3, 4], [0, 3]]
    assert levels[1][1][0] == 3


def test_fewer_periods_are_refused(spark):
    with pytest.raises(ValueError, match="four periods"):
        pr.detect_runs(docs(spark, ["a"]), times=3)


def test_longest_breaks_ties_by_start_then_period(spark):
    df = spark.createDataFrame([([(9, 8, 2), (3, 8, 2), (3, 8, 1), (0, 7, 1)],), ([],)], f"runs {pr.RUNS}")
    got = [r[0] for r in df.select(pr.longest(F.col("runs"))).collect()]
    assert tuple(got[0]) == (3, 8, 1) and got[1] is None


def cycled(doc_id, words):
    if doc_id is None or not words or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_equals_brute_force(spark):
    """The whole query against the statement of its result, on all short texts of the small table."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    seen = 0
    for doc_id, text in rows:
        words = [w.decode() for w in (text or "").encode().split()]
        if len(words) > 700:
            continue
        words = cycled(doc_id, words)
        runs = brute(words)
        r = got[doc_id]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(collapse(words, runs))
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        want = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        seen += len(runs)
    assert seen > 10


def test_odd_rows(spark):
    df = odd_docs(spark).withColumn("runs", F.lit("x")).withColumn("_text", F.lit(1))
    found = pr.detect_runs(df)
    assert found.count() == df.count()
    assert [tuple(r)[1:] for r in found.filter("doc_id < 4").collect()] == [(0, [], "")] * 3
    same = [tuple(r) for r in found.filter("doc_id = 6").collect()]
    assert len(same) == 2 and same[0] == same[1]
    assert pr.detect_runs(empty(spark)).collect() == []
    assert pr.with_cycles(df).count() == df.count()
    assert {r[1] for r in pr.with_cycles(df).filter("doc_id = 1 or doc_id = 7").collect()} == {None}
