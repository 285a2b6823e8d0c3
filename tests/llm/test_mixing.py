import math
from collections import defaultdict

import pytest

from textscore.llm import mixing as mx
from tests.llm.helpers import SCHEMA, empty, odd_docs, words


def corpus(spark, sizes, tokens=20):
    rows, n = [], 0
    for source, count in sizes.items():
        for _ in range(count):
            rows.append((n, " ".join(words(tokens, n)), "en", source, 0))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


def taken(df, **options):
    out = defaultdict(list)
    for r in mx.mix(df, **options).collect():
        out[r["source"]].append(r)
    return out


def shares(found):
    tokens = {s: sum(r["n_tokens"] for r in rows) for s, rows in found.items()}
    return {s: t / sum(tokens.values()) for s, t in tokens.items()}, tokens


def test_temperature_reaches_the_entropy(spark):
    df = corpus(spark, {"big": 300, "mid": 60, "small": 20, None: 10})
    p, tokens = shares(taken(df, target_entropy=0.9, max_repeats=None, block_tokens=200))
    entropy = -sum(v * math.log(v) for v in p.values()) / math.log(4)
    assert abs(entropy - 0.9) < 0.02 and set(p) == {"big", "mid", "small", None}
    assert abs(sum(tokens.values()) - 390 * 20) <= 4 * 20


def test_repetition_limit_binds(spark):
    df = corpus(spark, {"big": 300, "small": 10})
    found = taken(df, target_entropy=1.0, max_repeats=3.0, block_tokens=100)
    assert max(r["epoch"] for r in found["small"]) <= 2
    assert len(found["small"]) / 10 == pytest.approx(3.0, abs=0.2)


def test_epochs_are_permutations_and_starts_are_running_sums(spark):
    df = corpus(spark, {"a": 40, "b": 5}, tokens=7)
    found = taken(df, budget=45 * 7 * 2, target_entropy=1.0, max_repeats=None, block_tokens=50)
    for source, rows in found.items():
        rows.sort(key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [7 * k for k in range(len(rows))]
        epochs = defaultdict(list)
        for r in rows:
            epochs[r["epoch"]].append(r["doc_id"])
        full = [e for e in epochs if len(epochs[e]) == (40 if source == "a" else 5)]
        assert len(full) >= len(epochs) - 1
        assert all(len(set(v)) == len(v) for v in epochs.values())
    orders = [tuple(r["doc_id"] for r in found["b"] if r["epoch"] == e) for e in range(10)]
    assert len(set(orders)) > 3


def test_blocks_stay_together(spark):
    found = taken(corpus(spark, {"a": 80, "b": 80}, tokens=5), target_entropy=0.0, max_repeats=None, block_tokens=40)
    for rows in found.values():
        seen = [r["block"] for r in sorted(rows, key=lambda r: r["start"])]
        runs = [b for k, b in enumerate(seen) if k == 0 or seen[k - 1] != b]
        assert len(runs) == len(set(runs)) > 3


def test_many_blocks_over_several_chapters(spark):
    """Blocks of a word or two, so a source has hundreds: starts still run on without a gap."""
    found = taken(corpus(spark, {"a": 700, "b": 90}, tokens=3), target_entropy=0.0, max_repeats=None, block_tokens=2)
    for source, rows in found.items():
        rows.sort(key=lambda r: r["start"])
        assert [r["start"] for r in rows] == [3 * k for k in range(len(rows))]
        assert len({r["doc_id"] for r in rows if r["epoch"] == 0}) == {"a": 700, "b": 90}[source]
        assert len({r["block"] for r in rows}) > 0.4 * len({r["doc_id"] for r in rows})
        assert max(r["block"] for r in rows) < math.ceil(3 * {"a": 700, "b": 90}[source] / 2)


def test_odd_rows(spark):
    rows = mx.mix(odd_docs(spark)).collect()
    assert {r["doc_id"] for r in rows} <= {None, 4, 5, 6, 8} and sum(r["n_tokens"] for r in rows) > 30_000
    assert mx.mix(empty(spark)).collect() == []
    assert mx.mix(corpus(spark, {"one": 3})).count() == 3
    assert mx.mix(odd_docs(spark).filter("text IS NULL")).collect() == []
