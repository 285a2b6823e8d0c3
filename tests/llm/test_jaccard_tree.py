import random

import numpy as np
import pytest

from textscore.llm import jaccard_tree as jt
from textscore.llm.components import components
from tests.llm.helpers import docs, empty, odd_docs, words


def sets_of(texts):
    out = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(texts, percent=80):
    sets = sets_of(texts)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def variants(seed, groups=6, copies=9, length=120):
    """Groups of near copies with random edits at the border of the threshold, and shared passages."""
    r, texts = random.Random(seed), []
    passage = words(40, seed + 100)
    for g in range(groups):
        base = words(length + 10 * g, seed * 50 + g, 5000)
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = f"z{r.randrange(10 ** 6)}"
            if r.random() < 0.3:
                w = w[:r.randrange(len(w) // 2, len(w))]
            texts.append(" ".join(w))
        texts.append(" ".join(words(60, seed * 77 + g, 10 ** 5) + passage))
    texts += ["one two", "One  TWO", "one", "a b c d e", "a b c d e f", None, "", " \n"]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,hot,piece,large", [(1, 64, 2048, 64), (2, 3, 4, 64), (3, 1, 2, 1)])
def test_against_brute_force(spark, seed, hot, piece, large):
    texts = variants(seed)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"])
             for r in jt.near_duplicates(docs(spark, texts), hot=hot, piece=piece, large=large).collect()}
    assert found == brute(texts)


def test_near_copies_of_each_other_are_not_paired_one_by_one(spark, monkeypatch):
    """Members of large groups at the border of the threshold: rows grow with members, the result is that of all pairs."""
    r, texts = random.Random(11), []
    for g in range(2):
        base = words(150, 900 + g, 5000)
        for _ in range(90):
            w = list(base)
            for _ in range(r.randrange(2, 5)):
                w[r.randrange(len(w))] = f"z{r.randrange(10 ** 6)}"
            texts.append(" ".join(w))
    texts = list(enumerate(texts))
    made, write = {}, jt.materialise

    def counted(df, name, *args):
        out = write(df, name, *args)
        made[name] = made.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(jt, "materialise", counted)
    for piece in (2048, 32):
        made.clear()
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"])
                 for r in jt.near_duplicates(docs(spark, texts), piece=piece).collect()}
        assert found == brute(texts)
        assert made["pairs"] <= 4 * len(texts) and made["crowded-links"] > 0
        assert piece < 2048 or made["walked"] <= 4 * len(texts)


def test_spanning_links_join_what_all_links_join():
    r = np.random.default_rng(5)
    for trial in range(30):
        sets = []
        for _ in range(4):
            base = r.integers(0, 2 ** 63, int(r.integers(1, 200))).astype(np.uint64)
            for _ in range(8):
                keep = r.random(len(base)) > 0.15 * r.random()
                sets.append(np.unique(np.concatenate([base[keep], r.integers(0, 2 ** 63, 4).astype(np.uint64)])))
        def joined(pairs):
            label = np.arange(len(sets))
            for i, j in pairs:
                label[label == label[i]] = label[j]
            return [int(np.flatnonzero(label == x)[0]) for x in label]
        every = [(i, j) for i in range(len(sets)) for j in range(i)
                 if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - both)]
        found = jt.spanning_links(sets, np.arange(len(sets)), 80)
        assert set((max(p), min(p)) for p in found) <= set(every) and joined(found) == joined(every)
        comps = np.array(joined(every[::3]))
        assert joined(every[::3] + jt.spanning_links(sets, comps, 80)) == joined(every)


def test_odd_rows(spark):
    rows = jt.near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == 10
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["component_id"] is None
    assert all(by_id[i]["n_shingles"] == 0 and by_id[i]["component_id"] == i for i in (1, 2, 3, 7))
    assert by_id[4]["n_shingles"] == 1 and by_id[6]["component_id"] == 6
    assert jt.near_duplicates(empty(spark)).collect() == []


def test_walk_keeps_every_pair_that_links():
    r = np.random.default_rng(4)
    for trial in range(20):
        sets = []
        for _ in range(30):
            base = r.integers(0, 2 ** 63, int(r.integers(1, 300))).astype(np.uint64)
            sets.append(base)
            for _ in range(2):
                drop = r.random(len(base)) < 0.08
                sets.append(np.concatenate([base[~drop], r.integers(0, 2 ** 63, 3).astype(np.uint64)]))
        sets = [np.unique(s) for s in sets if len(s)]
        sizes = np.array([len(s) for s in sets])
        a, b = jt.block_pairs(np.arange(len(sets)), sizes, np.arange(len(sets)), [jt.bitmap(s) for s in sets], 80)
        found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
        for i in range(len(sets)):
            for j in range(i + 1, len(sets)):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                    assert (i, j) in found
        assert len(found) < len(sets) * (len(sets) - 1) // 4


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}}


def test_prefixes_share_a_token_that_is_not_hot():
    r = random.Random(8)
    for _ in range(300):
        n = r.randrange(1, 400)
        universe = [r.random() for _ in range(2 * n)]
        x = set(universe[:n])
        y = set(x)
        for t in list(x):
            if 100 * len(x & (y - {t})) >= 80 * len(x | (y - {t})) and r.random() < 0.3:
                y.discard(t)
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        heads = [sorted(s)[:int(jt.prefix_length(np.array(len(s)), 80))] for s in (x, y)]
        least = 1 + min(int(jt.extra(np.array(len(s)), 80)) for s in (x, y))
        assert len(set(heads[0]) & set(heads[1])) >= min(least, len(x & y))
