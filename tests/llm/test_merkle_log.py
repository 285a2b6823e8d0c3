import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.llm.helpers import SCHEMA, empty, odd_docs
from textscore.llm import merkle_log as ml
from textscore.llm.queries import merkle_query

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(row, **changed):
    values = [{**row, **changed}[f] for f in ml.FIELDS]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def steps(tree, i):
    out = []
    for nodes in tree[:-1]:
        at = i // 3 * 3
        out.append(("".join(nodes[at:i]), "".join(nodes[i + 1:at + 3])))
        i //= 3
    return out


def brute(rows):
    """[(doc_id, leaf, subroot, root, path)] by building every tree whole; sorted as tuples of strings."""
    groups = {}
    for r in rows:
        groups.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(r)
    order = sorted(groups)
    trees, members = [], []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        members.append(own)
        trees.append(levels([leaf(r) for r in own]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, (own, tree) in enumerate(zip(members, trees)):
        for i, r in enumerate(own):
            out.append((r["doc_id"], leaf(r), tree[-1][0], top[-1][0], steps(tree, i) + steps(top, k)))
    return out


def table(spark, sizes, seed=1):
    r, rows = random.Random(seed), []
    for source, n in sizes.items():
        rows += [(r.randrange(10 ** 6), f"text {k}\n{'é' * r.randrange(3)}", r.choice(["en", None]), source, r.randrange(9))
                 for k in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def dicts(df):
    return [r.asDict() for r in df.select(*ml.FIELDS).collect()]


def plain(df):
    return sorted([(r["doc_id"], r["leaf"], r["subroot"], r["root"], [tuple(s) for s in r["path"]])
                   for r in df.collect()], key=str)


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 3}, {"a": 4}, {"a": 27, "b": 1, None: 2, "": 5},
    {"hot": 2200, "b": 729, "c": 730, "d": 28, "é": 9, "z": 1}])
def test_proofs_equal_whole_trees(spark, sizes):
    df = table(spark, sizes)
    assert plain(ml.build(df).proofs()) == sorted(brute(dicts(df)), key=str)


def test_many_sources(spark):
    """The tree of the subroots has several builders, too."""
    df = table(spark, {f"s{k}": 1 + k % 2 for k in range(800)})
    assert plain(ml.build(df).proofs()) == sorted(brute(dicts(df)), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100, 243, 244])
def test_positions_are_those_of_completion(n):
    """The closed form against appending node by node."""
    order, open_nodes, done = [], [[] for _ in range(12)], [0] * 12
    top = next(k for k in range(12) if 3 ** k >= n)
    def close(level):
        order.append((level, done[level]))
        done[level] += 1
        if level < top:
            open_nodes[level + 1].append(1)
            if len(open_nodes[level + 1]) == 3:
                open_nodes[level + 1] = []
                close(level + 1)
    for _ in range(n):
        close(0)
    for level in range(1, top + 1):
        if open_nodes[level]:
            open_nodes[level] = []
            close(level)
    assert [int(ml.place(level, i, n)) for level, i in order] == list(range(len(order)))


def test_log_is_whole_and_in_place(spark):
    df = table(spark, {"hot": 2200, "b": 40})
    log = ml.build(df).nodes().collect()
    for tree, n in (("shot", 2200), ("sb", 40), (None, 2)):
        own = sorted((r for r in log if r["tree"] == tree), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(sum(-(-n // 3 ** k) for k in range(len(levels([""] * n))))))
        assert all(r["n"] == n and ml.place(r["level"], r["idx"], n) == r["position"] for r in own)


def test_fold_finds_changed_rows_only(spark):
    df = table(spark, {"a": 900, "b": 7})
    claimed = {"text": F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))}
    rows = ml.build(df, claimed=claimed).proofs().withColumn("got", ml.fold(F.col("path"), F.col("claimed")))
    assert {(r["doc_id"] % 2, r["got"] == r["root"]) for r in rows.collect()} == {(0, False), (1, True)}


def test_odd_rows(spark):
    df = odd_docs(spark).withColumns({"leaf": F.lit("x"), "idx": F.lit(1), "tree": F.lit(2), "path": F.lit(3)})
    assert plain(ml.build(df).proofs()) == sorted(brute(dicts(df)), key=str)
    none = ml.build(empty(spark))
    assert none.root is None and none.proofs().collect() == [] and none.nodes().collect() == []


def test_query_and_sql_equal_brute_force(spark, tmp_path):
    rows = [(k, f"line {k}\nline{' more' * (k % 3)}" if k % 4 else f"one {k}", "en", f"s{k % 3}" if k % 5 else None, k)
            for k in range(60)] + [(100, None, None, "s1", None), (101, "", "", "", 0), (None, "a\nb", "en", "s1", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in merkle_query(spark, str(tmp_path)).collect()), key=str)
    by_leaf = {leaf(r): r for r in dicts(df)}
    want = []
    for doc_id, own, subroot, root, path in brute(dicts(df)):
        r, acc = by_leaf[own], own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and r["text"] is not None:
            acc = leaf(r, text=r["text"].replace("\n", ""))
        for a, b in path:
            acc = H(a + acc + b)
        want.append((doc_id, own, subroot, root, H("".join(a + b for a, b in path)), acc, acc == root))
    assert got == sorted(want, key=str)
    assert {w[-1] for w in want} == {True, False}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(ml.oracle())
    assert [c[0] for c in found.description] == merkle_query(spark, str(tmp_path)).columns
    assert sorted(found.fetchall(), key=str) == got


def test_place_takes_arrays():
    assert np.array_equal(ml.place(np.array([0, 1]), np.array([3, 0]), np.array([9, 9])), [4, 3])
