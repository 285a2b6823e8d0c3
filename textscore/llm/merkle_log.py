"""Merkle manifest of a dataset as a postorder append log.

Every row is a leaf: the SHA-256 of its fields. The leaves of a tree (one per source) ascend by id; every `ARITY`
consecutive nodes of a level, at its end fewer, even one, become their hash, until one is left, the
subroot. The subroots, by source, give the root in the same way.

Aligned builders. A builder takes the nodes of one level whose numbers agree up to the last `DEPTH` digits: a
whole subtree of at most ARITY^DEPTH nodes. It reads them in order, keeps the unfinished nodes of each
level on a stack and appends every node when its last child is there, children before parents. The
roots of the builders are the input of the next round, so there are log(n) / DEPTH rounds, and a hot source is
just more builders.

Positions. In completion order a node's place in the log of its tree has a closed form: with e its last
leaf, e leaves and the sum of e // ARITY^t finished nodes are before leaf e, and the node follows it at a
distance of its level. Inside a builder's segment the same form addresses all siblings of a leaf's path, which
is how proofs are read off the log: each segment once, extended by the path of the segment's root, from the
last round back to the first. No task holds more than one segment and no join repeats a leaf.

The nodes of a level travel as digests; texts are read once and never shuffled. Ranks come from slices of the
order, so no task sorts a whole source.

Defined results: a null field is `-`, an empty one `0:`. A null source is a tree of its own, the first; a
null id comes first in its tree; rows with equal ids are ordered by their digests, so equal rows are
leaves of equal digests side by side. An empty table has no rows and no root. Extra columns stay out, whatever
their names.
"""

import hashlib
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textscore.operators.joins import lookup_join
from textscore.operators.ordering import row_index
from textscore.sources.work import materialise

ARITY, DEPTH = 3, 6
BLOCK = ARITY ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    """A field as it is hashed: its bytes' count, a colon and itself, or `-`."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown), F.lit(":"), shown), F.lit("-"))


def leaf_digest(values):
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def height(n):
    """Levels above the leaves of a tree of n leaves (a column)."""
    return reduce(add, [(F.lit(ARITY ** k) < n).cast("int") for k in range(39)])


def place(level, index, n):
    """Position in the log of node `index` of a level of a tree of n leaves (integers or arrays)."""
    last = np.minimum((np.asarray(index, np.int64) + 1) * ARITY ** np.asarray(level, np.int64), n) - 1
    found, rest = last + level, last // ARITY
    while np.any(rest):
        found, rest = found + rest, rest // ARITY
    return found


class Builder:
    """Appends the nodes of one aligned subtree; `base` is the level and `first` the number of its first input."""

    def __init__(self, base, first, n, write):
        self.base, self.next, self.n, self.write = base, first, n, write
        self.top = next(k for k in range(64) if ARITY ** k >= n)
        self.stack = [[] for _ in range(DEPTH + 1)]

    def _close(self, level, last):
        value = digest(self.stack[level])
        self.stack[level] = []
        self.stack[level + 1].append(value)
        self.write(self.base + level + 1, last // ARITY ** (level + 1), value)

    def append(self, value):
        self.stack[0].append(value)
        if self.base == 0:
            self.write(0, self.next, value)
        level = 0
        while level < DEPTH and len(self.stack[level]) == ARITY:
            self._close(level, self.next)
            level += 1
        self.next += 1

    def finish(self):
        """The last nodes of a tree have fewer children; they end with it."""
        for level in range(min(DEPTH, self.top - self.base)):
            if self.stack[level]:
                self._close(level, self.next - 1)


def _round(nodes, base):
    """(tree, n, level, idx, position, digest): what the builders of one round append, in their order."""
    def run(batches):
        key, builder, out = None, None, []
        write = lambda *node: out.append((key[0], key[2], *node))

        def taken():
            tree, n, level, idx, value = zip(*out)
            places = place(np.array(level), np.array(idx), np.array(n))
            out.clear()
            return pa.RecordBatch.from_pydict({
                "tree": pa.array(tree, pa.string()), "n": pa.array(n, pa.int64()), "level": pa.array(level, pa.int32()),
                "idx": pa.array(idx, pa.int64()), "position": pa.array(places, pa.int64()),
                "digest": pa.array(value, pa.string())})

        for batch in batches:
            for tree, n, block, idx, value in zip(*(batch.column(c).to_pylist() for c in (
                    "tree", "n", "block", "idx", "digest"))):
                if (tree, block, n) != key:
                    if builder:
                        builder.finish()
                    key = (tree, block, n)
                    builder = Builder(base, idx, n, write)
                builder.append(value)
            if out:
                yield taken()
        if builder:
            builder.finish()
        if out:
            yield taken()

    rows = (nodes.select("tree", "n", F.floor(F.col("idx") / BLOCK).alias("block"), "idx", "digest")
            .repartition("tree", "block").sortWithinPartitions("tree", "block", "idx"))
    return rows.mapInArrow(run, "tree string, n long, level int, idx long, position long, digest string")


def rounds(most):
    """The base levels of the rounds for trees of at most `most` leaves."""
    return [k for k in range(0, 64, DEPTH) if k == 0 or ARITY ** k < most]


def append_log(leaves):
    """The log of all trees of `leaves` (tree, n, idx, digest): one written table per round."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    parts, nodes = [], leaves
    for base in rounds(most):
        part = materialise(_round(nodes, base), "merkle-log")
        parts.append(part)
        # A tree that ended in this round has its root there and goes no further.
        nodes = part.filter((F.col("level") == base + DEPTH) & (F.col("n") > ARITY ** (base + DEPTH)))
    return parts


def roots(log):
    """(tree, n, digest) of the trees."""
    every = reduce(lambda a, b: a.unionByName(b), log)
    return every.filter(F.col("level") == height(F.col("n"))).select("tree", "n", "digest")


def _paths(segment, outer, members, base, kept):
    """`members` (tree, n, block, idx and the `kept` columns) with `path`, read off their builders' segments.

    `segment` holds the log's rows of the levels base .. base + DEPTH - 1, `outer` (tree, block, path) the
    paths of the builders' roots.
    """
    marks = (segment.select("tree", "block", "n", "level", "position", "digest", F.lit(None).cast(PATH).alias("path"))
             .unionByName(outer.select("tree", "block", F.lit(None).cast("long").alias("n"),
                                       F.lit(-1).alias("level"), F.lit(-1).cast("long").alias("position"),
                                       F.lit(None).cast("string").alias("digest"), "path")))
    made = [f for f in members.schema if f.name in ("tree", "idx", *kept)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made) + f", path {PATH}"

    def run(log, rows):
        log = log.sort_by("position")
        tail = log.column("path")[0].as_py()                    # the root's mark comes first
        log = log.slice(1)
        levels, values = np.asarray(log.column("level")) - base, log.column("digest").to_pylist()
        n = int((levels == 0).sum())
        # Per node of the segment the digests of its siblings before and after it.
        left, right = [""] * len(values), [""] * len(values)
        for level in range(int(levels.max()) + 1):
            width = -(-n // ARITY ** level)
            at = place(level, np.arange(width), n)
            for k in range(0, width, ARITY):
                group = [values[p] for p in at[k:k + ARITY]]
                for i, p in enumerate(at[k:k + ARITY]):
                    left[p], right[p] = "".join(group[:i]), "".join(group[i + 1:])
        own = np.asarray(rows.column("idx")) % BLOCK
        steps = int(levels.max()) + 1
        if n == 1 and ARITY ** base >= log.column("n")[0].as_py():
            steps = 0                                           # the only node of its level is the tree's root
        spots = np.stack([place(k, own // ARITY ** k, n) for k in range(steps)]
                         + [np.full(len(own), len(values) + k) for k in range(len(tail))], axis=1) \
            if steps + len(tail) else np.zeros((len(own), 0), np.int64)
        both = [pa.array(side + [t[name] for t in tail], pa.string()).take(pa.array(spots.ravel()))
                for side, name in ((left, "left"), (right, "right"))]
        edges = np.arange(len(own) + 1, dtype=np.int32) * spots.shape[1]
        path = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(both, ["left", "right"]))
        return pa.table({f.name: rows.column(f.name) for f in made} | {"path": path})

    by = lambda df: df.groupBy("tree", "block")
    return by(members).cogroup(by(marks)).applyInArrow(lambda a, b: run(b, a), schema)


def _block(df):
    return df.withColumn("block", F.floor(F.col("idx") / BLOCK))


def paths(log, leaves, tails, kept=()):
    """`leaves` (tree, n, idx, the `kept` columns) with `path`: the siblings before and after, level by level.

    `tails` (tree, n, path) is what follows the path of each tree's root.
    """
    bases = rounds(leaves.agg(F.max("n")).first()[0] or 0)
    above = None
    for base, part in reversed(list(zip(bases, log))):
        ends = (height(F.col("n")) <= base + DEPTH) & ((height(F.col("n")) > base) | F.lit(base == 0))
        outer = tails.filter(ends).select("tree", F.lit(0).cast("long").alias("block"), "path")
        if above is not None:
            outer = outer.unionByName(above.select("tree", F.col("idx").alias("block"), "path"))
        inner = (F.col("level") < base + DEPTH) & ((F.col("level") < height(F.col("n"))) | (F.col("n") == 1))
        level = F.col("level") - base
        # The level below is a round of its own; its roots are this one's leaves.
        segment = part.filter(inner)
        if base:
            below = log[bases.index(base) - 1].filter((F.col("level") == base) & (height(F.col("n")) > base))
            segment = segment.unionByName(below)
            members = _block(below)
        else:
            members = _block(leaves)
        segment = segment.withColumn("block", F.floor(F.col("idx") / F.pow(F.lit(float(ARITY)), F.lit(DEPTH) - level)))
        above = _paths(segment, outer, members, base, kept if base == 0 else ())
        if base:
            above = materialise(above, "merkle-paths")
    return above


def fold(path, leaf):
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(path):
    """All digests of a path, level by level, from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def _ranked(df, tree, order, name):
    """`df` with `idx` and `n`: the place in its tree and the tree's leaves."""
    ranked = materialise(row_index(df, [tree, *order], "_at"), name)
    trees = materialise(ranked.groupBy(tree).agg(F.min("_at").alias("_from"), F.count("*").alias("n")), "trees")
    return lookup_join(ranked, trees, tree, "inner").withColumn("idx", F.col("_at") - F.col("_from")).drop("_at", "_from")


class Manifest:
    """The log of a dataset: `sources` and `top` (written tables, one per round), `leaves`, `trees` and the `root`."""

    def __init__(self, sources, top, leaves, trees, root):
        self.sources, self.top, self.leaves, self.trees, self.root = sources, top, leaves, trees, root

    def nodes(self):
        """(tree, n, level, idx, position, digest) of all nodes; the tree of the subroots is null."""
        log = [*self.sources, *[p.withColumn("tree", F.lit(None).cast("string")) for p in self.top]]
        return reduce(lambda a, b: a.unionByName(b), log)

    def proofs(self):
        """(doc_id, claimed, leaf, subroot, root, path) of every leaf."""
        if self.root is None:
            rows = self.leaves.withColumns({"subroot": F.lit(""), "root": F.lit(""), "path": F.lit(None).cast(PATH)})
        else:
            top = F.lit("").alias("tree"), F.lit(self.trees.count()).cast("long").alias("n")
            end = self.trees.sparkSession.range(1).select(*top, F.array().cast(PATH).alias("path"))
            subroots = self.trees.select(*top, "idx", F.col("tree").alias("name"), F.col("n").alias("leaves"), "digest")
            tails = paths(self.top, subroots, end, ("name", "leaves", "digest"))
            tails = materialise(tails.select(F.col("name").alias("tree"), F.col("leaves").alias("n"), "digest", "path"),
                                "merkle-tails")
            rows = paths(self.sources, self.leaves, tails, ("doc_id", "claimed", "leaf"))
            subroots = tails.select("tree", F.col("digest").alias("subroot"))
            rows = lookup_join(rows, subroots, "tree", "inner").withColumn("root", F.lit(self.root))
        return rows.select("doc_id", "claimed", "leaf", "subroot", "root", "path")


def build(docs, fields=FIELDS, key="doc_id", source="source", claimed=None):
    """The manifest of `docs`. `claimed` maps field names to the values (columns) that are to be verified."""
    column = lambda c: F.col(f"`{c}`")
    values = {f: column(f) for f in fields}
    # Trees are named so that null differs from an empty source and comes first.
    tree = F.coalesce(F.concat(F.lit("s"), column(source).cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), column(key).alias("doc_id"),
                         leaf_digest(values.values()).alias("leaf"),
                         leaf_digest((values | (claimed or {})).values()).alias("claimed"))
    leaves = materialise(_ranked(leaves, "tree", ["doc_id", "leaf"], "merkle-ranks"), "merkle-leaves")
    log = append_log(leaves.withColumnRenamed("leaf", "digest"))
    if not leaves.agg(F.max("n")).first()[0]:
        return Manifest(log, [], leaves, None, None)
    trees = row_index(materialise(roots(log), "subroots"), ["tree"], "idx")
    trees = materialise(trees, "merkle-trees")
    count = trees.count()
    top = append_log(trees.select(F.lit("").alias("tree"), F.lit(count).cast("long").alias("n"), "idx", "digest"))
    return Manifest(log, top, leaves, trees, roots(top).first()["digest"])


def _sql_leaf(text):
    fields = [text if f == "text" else f for f in FIELDS]
    return "sha256(" + " || ".join(
        f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


def _sql_nodes(name, leaves):
    """The nodes of all levels, and for each node below a root its siblings before and after it."""
    return f"""
    {name} AS (
      SELECT s, 0 AS lvl, idx, h, n FROM {leaves}
      UNION ALL
      SELECT s, lvl + 1, idx // {ARITY}, sha256(string_agg(h, '' ORDER BY idx)), (n + {ARITY - 1}) // {ARITY}
      FROM {name} WHERE n > 1 GROUP BY s, lvl, idx // {ARITY}, n),
    {name}_beside AS (
      SELECT a.s, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS a,
             coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS b
      FROM {name} a JOIN {name} b ON a.s = b.s AND a.lvl = b.lvl AND a.idx // {ARITY} = b.idx // {ARITY}
      WHERE a.n > 1 GROUP BY 1, 2, 3)"""


def oracle():
    """SQL for the proofs of `documents` when the line feeds of texts with an even crc32 of the id are deleted."""
    up = f"CAST(pow({ARITY}, b.lvl) AS BIGINT)"
    return f"""
    WITH RECURSIVE
    crc AS (SELECT list(c ORDER BY i) AS t FROM (
      SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
             CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
      FROM (SELECT unnest(range(256)) AS i))),
    marked AS (
      SELECT d.*, xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1),
                        lambda k: ord(substr(doc_id::VARCHAR, k, 1))::BIGINT),
                        lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 2 = 0 AS even
      FROM documents d, crc),
    leaves AS (
      SELECT doc_id, coalesce('s' || source, '') AS s, {_sql_leaf('text')} AS h,
             CASE WHEN even THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf('text')} END AS claimed
      FROM marked),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
             count(*) OVER (PARTITION BY s) AS n FROM leaves),
    {_sql_nodes('nodes', 'ranked')},
    subroots AS (
      SELECT '' AS s, s AS name, h, row_number() OVER (ORDER BY s) - 1 AS idx, count(*) OVER () AS n
      FROM nodes WHERE n = 1),
    {_sql_nodes('top', 'subroots')},
    steps AS (
      SELECT r.s, r.idx, b.lvl AS step, b.a, b.b FROM ranked r
      JOIN nodes_beside b ON b.s = r.s AND b.idx = r.idx // {up}
      UNION ALL
      SELECT r.s, r.idx, 1000 + b.lvl, b.a, b.b FROM ranked r JOIN subroots u ON u.name = r.s
      JOIN top_beside b ON b.idx = u.idx // {up}),
    paths AS (
      SELECT s, idx, list({{'a': a, 'b': b}} ORDER BY step) AS path, string_agg(a || b, '' ORDER BY step) AS beside
      FROM steps GROUP BY 1, 2),
    proofs AS (
      SELECT r.doc_id, r.h AS leaf, u.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
             sha256(coalesce(p.beside, '')) AS proof_sha256,
             list_reduce([{{'a': r.claimed, 'b': ''}}] || coalesce(p.path, []),
                         lambda x, y: {{'a': sha256(y.a || x.a || y.b), 'b': ''}}).a AS folded_root
      FROM ranked r JOIN subroots u ON u.name = r.s LEFT JOIN paths p ON p.s = r.s AND p.idx = r.idx)
    SELECT *, folded_root = root AS verified FROM proofs"""
