"""N-gram Jaccard join with signature trees.

A document's set is its distinct five-word shingles (A-Z lower-cased; with fewer words the whole
sequence; without words nothing), as 64-bit hashes. Documents link at a similarity of `percent` or more.

1. Equal sets are one class (128-bit digest), its number the smallest id. Copies are never paired.
2. Blocks. In the order of the hashes, similar sets share a token among their first
   `size - least overlap + 1 + extra` ones. A Bloom filter drops tokens held once; tokens of more than `hot`
   classes are hot. If two similar sets share only hot ones, both hold more hot tokens than `extra` allows
   (they are `full`), so hot blocks need their full members only.
3. Hubs. In each block every class is compared with one fixed member, its hub, so a group of near copies
   becomes a star. Verified links give components. Blocks with one hub form a group.
4. Signature trees, over groups that still hold several components. Nodes hold the OR of their members'
   token bitmaps, the range of their sizes and of their components; two trees are walked in pairs from
   the root, and a pair of nodes is dropped if the sizes are too far apart, the component is one, or the
   largest possible overlap, popcount(A & B) plus the tokens hidden by equal bits, is too small.
   Pairs of leaves that remain are verified on the whole sets. Where more than two a member remain, as among
   near copies of each other, the members themselves are sent on, and one task decides on their whole sets, leaving
   out pairs that links found before hold together, so rows grow with members and not with pairs. A very large group
   is dealt into pieces, every pair of pieces one task's work.
5. Components of all links, joined back to all documents.

No step caps anything: what the bitmaps cannot rule out is decided on whole sets, and links are exact up to
equal 64-bit hashes of different shingles. Links, sets and components never reach the driver; it holds two
Bloom filters of fixed size.

Defined results: null and empty texts have size 0 and are linked with nothing. Rows with a null
id take no part and get a null component. Rows of one id are one document for links if their texts
are equal, else each links its own. Extra columns stay out.
"""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textscore.llm.components import components
from textscore.llm.text import Words, combine, in_small_batches, mix, slices
from textscore.sources.work import materialise

SHINGLE = 5
BLOOM_BITS = 1 << 25
PROBES = 2
PIECE_TOKENS = 1 << 21


def shingle_sets(texts):
    """(sizes, tokens, first): the sorted distinct shingle hashes of each text, end to end."""
    words = Words(texts)
    windows = combine(words.hash, SHINGLE)
    n = len(windows)
    inside = np.flatnonzero(words.text[:n] == words.text[SHINGLE - 1:]) if n else np.zeros(0, np.int64)
    owner, token = words.text[inside], windows[inside]
    short = np.flatnonzero((words.count > 0) & (words.count < SHINGLE))
    if len(short):
        whole = np.array([combine(words.hash[words.first[i]:words.first[i + 1]], int(words.count[i]))[0]
                          + words.count[i].astype(np.uint64) for i in short], np.uint64)
        owner, token = np.concatenate([owner, short]), np.concatenate([token, whole])
        order = np.argsort(owner, kind="stable")
        owner, token = owner[order], token[order]
    border = np.searchsorted(owner, np.arange(len(texts) + 1))
    for a, b in zip(border, border[1:]):
        token[a:b].sort()                               # one text at a time: short runs sort fast
    if len(token):
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        owner, token = owner[new], token[new]
    sizes = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    return sizes, token, np.concatenate([[0], np.cumsum(sizes)])


def need(a, b, percent):
    """The least overlap of two linked sets of sizes a and b (as arrays)."""
    return -(-percent * (a + b) // (100 + percent))


def extra(n, percent):
    """Tokens by which the block prefix is longer than the pigeonhole asks for."""
    return np.minimum(8 + n // 20, -(-percent * n // 100) - 1)


def prefix_length(n, percent):
    return np.minimum(n, n - -(-percent * n // 100) + 1 + extra(n, percent))


def width_of(n):
    """Bits of a bitmap: a power of two, 2 to 4 for each token, 64 at least."""
    return max(64, 1 << (2 * int(n) - 1).bit_length())


def bitmap(tokens, width=None):
    """The bitmap of a set, as bytes."""
    width = width or width_of(len(tokens))
    bits = np.zeros(width, np.uint8)
    bits[(mix(tokens) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(maps, width):
    """Bitmaps [rows, words] OR-ed down to `width` bits."""
    while maps.shape[1] * 64 > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class SignatureTree:
    """Levels of nodes from leaves to root: OR bitmaps, size and component ranges, hidden tokens."""

    def __init__(self, sizes, comps, maps, fanout=8):
        self.order = np.lexsort((*maps.T[:2], sizes, comps))
        sizes, comps, maps = sizes[self.order], comps[self.order], maps[self.order]
        hidden = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        level = {"lo": sizes, "hi": sizes, "c0": comps, "c1": comps, "hidden": hidden, "maps": maps}
        self.levels, self.fanout = [level], fanout
        while len(level["lo"]) > 1:
            at = np.arange(0, len(level["lo"]), fanout)
            level = {"lo": np.minimum.reduceat(level["lo"], at), "hi": np.maximum.reduceat(level["hi"], at),
                     "c0": np.minimum.reduceat(level["c0"], at), "c1": np.maximum.reduceat(level["c1"], at),
                     "hidden": np.maximum.reduceat(level["hidden"], at),
                     "maps": np.bitwise_or.reduceat(level["maps"], at, axis=0)}
            self.levels.append(level)

    def __len__(self):
        return len(self.levels[0]["lo"])


def _may_link(a, b, i, j, percent):
    """Which node pairs (i of level a, j of level b) can hold a link between two components."""
    ok = (100 * a["hi"][i] >= percent * b["lo"][j]) & (100 * b["hi"][j] >= percent * a["lo"][i])
    ok &= ~((a["c0"][i] == a["c1"][i]) & (b["c0"][j] == b["c1"][j]) & (a["c0"][i] == b["c0"][j]))
    i, j = i[ok], j[ok]
    shared = np.zeros(len(i), np.int64)
    for k in range(0, len(i), 4096):
        part = slice(k, k + 4096)
        shared[part] = np.bitwise_count(a["maps"][i[part]] & b["maps"][j[part]]).sum(1)
    most = shared + np.minimum(a["hidden"][i], b["hidden"][j])
    ok = most >= need(a["lo"][i], b["lo"][j], percent)
    return i[ok], j[ok]


def dual_walk(a, b, percent):
    """Leaf pairs (positions in the order given) that no bound rules out; `a is b` walks one tree."""
    same = a is b
    top = min(len(a.levels), len(b.levels)) - 1
    rows_a, rows_b = len(a.levels[top]["lo"]), len(b.levels[top]["lo"])
    i, j = (x.ravel() for x in np.mgrid[:rows_a, :rows_b])
    for level in range(top, -1, -1):
        if level < top:
            steps = np.arange(a.fanout)
            i = (i[:, None, None] * a.fanout + steps[:, None] + 0 * steps).ravel()
            j = (j[:, None, None] * a.fanout + 0 * steps[:, None] + steps).ravel()
            real = (i < len(a.levels[level]["lo"])) & (j < len(b.levels[level]["lo"]))
            i, j = i[real], j[real]
        if same:
            keep = i < j if level == 0 else i <= j
            i, j = i[keep], j[keep]
        i, j = _may_link(a.levels[level], b.levels[level], i, j, percent)
    return a.order[i], b.order[j]


def block_pairs(ids, sizes, comps, maps, percent, sides=None):
    """Pairs of ids in one block that may link across components; `sides` 0/1 asks for cross pairs."""
    widths = np.array([len(m) * 8 for m in maps])
    groups = {}
    for side in (None,) if sides is None else (0, 1):
        for w in np.unique(widths):
            at = np.flatnonzero((widths == w) & (True if side is None else sides == side))
            if len(at):
                table = np.stack([np.frombuffer(maps[k], np.uint64) for k in at])
                groups[side, int(w)] = at, table
    found = []
    for (s, w), (at, table) in groups.items():
        for (s2, w2), (at2, table2) in groups.items():
            if w2 not in (w, 2 * w) and not (sides is not None and w == 2 * w2):
                continue
            if sides is None:
                one = SignatureTree(sizes[at], comps[at], table)
                two = one if w2 == w else SignatureTree(sizes[at2], comps[at2], fold(table2, w))
            elif s == 0 and s2 == 1:
                low = min(w, w2)
                one = SignatureTree(sizes[at], comps[at], fold(table, low))
                two = SignatureTree(sizes[at2], comps[at2], fold(table2, low))
            else:
                continue
            i, j = dual_walk(one, two, percent)
            found.append((ids[at[i]], ids[at2[j]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _bits(values):
    return [(mix(values + np.uint64(977 * k + 1)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)
            for k in range(PROBES)]


def bloom(values, column):
    """A broadcast bitmap of fixed size of a column of longs; its words are OR-ed by Spark."""
    def run(batches):
        for batch in batches:
            v = np.asarray(batch.column(0)).view(np.uint64)
            spots = np.unique(np.concatenate(_bits(v)))
            yield pa.RecordBatch.from_pydict({"word": pa.array(spots >> 6),
                                              "bits": pa.array((np.uint64(1) << (spots & 63).astype(np.uint64)).view(np.int64))})

    rows = (values.select(F.col(column).cast("long")).mapInArrow(run, "word long, bits long")
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow())
    words = np.zeros(BLOOM_BITS // 64, np.uint64)
    words[np.asarray(rows["word"])] = np.asarray(rows["bits"]).view(np.uint64)
    return values.sparkSession.sparkContext.broadcast(words.tobytes())


def held(shared, values):
    """Which values the bitmap may hold."""
    words = np.frombuffer(shared.value, np.uint64)
    ok = np.ones(len(values), bool)
    for spots in _bits(values):
        ok &= (words[spots >> 6] >> (spots & 63).astype(np.uint64)) & np.uint64(1) > 0
    return ok


def describe(docs):
    """(_id, _copy, n, d1, d2, map): size, digest and bitmap of each document's set."""
    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                sizes, token, first = shingle_sets(texts)
                total = lambda x: np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])[first])
                yield pa.RecordBatch.from_pydict({
                    "_id": rows.column("_id"), "_copy": rows.column("_copy"), "n": pa.array(sizes),
                    "d1": pa.array(mix(total(token) + sizes.astype(np.uint64)).view(np.int64)),
                    "d2": pa.array(mix(total(mix(token)) ^ sizes.astype(np.uint64)).view(np.int64)),
                    "map": pa.array([bitmap(token[a:b]) if b > a else b"" for a, b in zip(first, first[1:])],
                                    pa.binary())})

    return docs.mapInArrow(run, "_id long, _copy long, n long, d1 long, d2 long, map binary")


def _prefix_rows(docs, percent, shared=None):
    """(token, _id, n): the block prefix of each document, or its part that the bitmap may hold."""
    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                sizes, token, first = shingle_sets(texts)
                length = prefix_length(sizes, percent)
                length[sizes == 0] = 0
                begin = np.cumsum(length) - length
                at = np.arange(int(length.sum())) - np.repeat(begin, length) + np.repeat(first[:-1], length)
                owner = np.repeat(np.arange(len(texts)), length)
                chosen = token[at]
                if shared is None:
                    yield pa.RecordBatch.from_pydict({"token": pa.array(chosen.view(np.int64))})
                    continue
                ok = held(shared, chosen)
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(chosen[ok].view(np.int64)),
                    "_id": rows.column("_id").take(pa.array(owner[ok])), "n": pa.array(sizes[owner[ok]])})

    return docs.mapInArrow(run, "token long" if shared is None else "token long, _id long, n long")


def _sets(docs, shared):
    """(_id, tokens): the whole sets of the documents whose id the bitmap may hold."""
    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("_id"))
            some = batch.filter(pa.array(held(shared, ids.view(np.uint64))))
            for rows, texts in slices(some, "_text"):
                sizes, token, first = shingle_sets(texts)
                yield pa.RecordBatch.from_pydict({
                    "_id": rows.column("_id"),
                    "tokens": pa.array([token[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())})

    return docs.mapInArrow(run, "_id long, tokens binary")


def _not_ruled_out(pairs, maps, percent):
    """Pairs (a, b) whose bitmaps leave a link possible; `maps` is (_id, n, map)."""
    side = lambda c: maps.select(F.col("_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("map").alias(f"map_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            n_a, n_b = np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b"))
            keep = np.zeros(batch.num_rows, bool)
            maps_a, maps_b = batch.column("map_a").to_pylist(), batch.column("map_b").to_pylist()
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(m, np.uint64)[None, :] for m in (maps_a[k], maps_b[k]))
                low = 64 * min(x.shape[1], y.shape[1])
                x, y = fold(x, low), fold(y, low)
                hidden = min(n_a[k] - int(np.bitwise_count(x).sum()), n_b[k] - int(np.bitwise_count(y).sum()))
                keep[k] = int(np.bitwise_count(x & y).sum()) + hidden >= need(n_a[k], n_b[k], percent)
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(keep)) for c in ("a", "b")})

    return joined.select("a", "b", "n_a", "n_b", "map_a", "map_b").mapInArrow(run, "a long, b long")


def verify(pairs, docs, percent):
    """The pairs (a, b) that link, decided on the whole sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    sets = _sets(docs, bloom(ends, "id"))
    side = lambda c: sets.select(F.col("_id").alias(c), F.col("tokens").alias(f"tokens_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in ("tokens_a", "tokens_b"))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(keep)) for c in ("a", "b")})

    return joined.select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def _dense(at, at2, size):
    """(part, crowded) of the pairs of positions: the least position that pairs lead to, and whether its part holds more than
    two pairs a member."""
    part = np.arange(size)
    while True:
        least = np.minimum(part[at], part[at2])
        new = part.copy()
        np.minimum.at(new, at, least)
        np.minimum.at(new, at2, least)
        new = new[new]
        if (new == part).all():
            break
        part = new
    members = np.bincount(part, minlength=size)
    pairs = np.bincount(part[at], minlength=size)
    return part, (pairs > 2 * members)[part]


def _walk_blocks(rows, percent, large):
    """Pairs (a, b) from the rows of dealt groups, one tree walk each; of crowded parts the members (a, comp) under
    (hub, left, right, part) instead, b null."""
    def finish(group, key):
        hub, left, right = key
        ids, sizes, comps = (np.array(x, np.int64) for x in group[:3])
        sides = np.array(group[4]) if left != right else None
        at, at2 = block_pairs(np.arange(len(ids)), sizes, comps, group[3], percent, sides)
        hubs = [None if h is None else frozenset(h) for h in group[5]]
        first = [i for i, (x, y) in enumerate(zip(at, at2))
                 if hubs[x] is None or hubs[y] is None or min(hubs[x] & hubs[y]) == hub]
        first = np.array(first, np.int64)
        at, at2 = at[first], at2[first]
        part, crowded = _dense(at, at2, len(ids))
        if len(ids) <= large:
            crowded[:] = False
        few, member = ~crowded[at], np.flatnonzero(crowded)
        single, nothing = len(member), int(few.sum())
        columns = {"a": np.concatenate([ids[at[few]], ids[member]]), "b": ids[at2[few]],
                   "hub": np.full(single, hub), "left": np.full(single, left), "right": np.full(single, right),
                   "part": part[member], "comp": comps[member]}
        blank = lambda n: pa.nulls(n, pa.int64())
        pad = {c: pa.chunked_array([pa.array(v)] if c == "a" else [pa.array(v), blank(single)] if c == "b"
                                   else [blank(nothing), pa.array(v)], pa.int64()).combine_chunks()
               for c, v in columns.items()}
        return pa.RecordBatch.from_pydict(pad)

    def run(batches):
        key, group = None, None
        for batch in batches:
            for hub, left, right, side, i, n, comp, hubs, bits in zip(*(batch.column(c).to_pylist() for c in (
                    "hub", "left", "right", "side", "id", "n", "comp", "hubs", "map"))):
                if (hub, left, right) != key:
                    if group:
                        yield finish(group, key)
                    key, group = (hub, left, right), ([], [], [], [], [], [])
                for to, value in zip(group, (i, n, comp, bits, side, hubs)):
                    to.append(value)
        if group:
            yield finish(group, key)

    return rows.mapInArrow(run, "a long, b long, hub long, left long, right long, part long, comp long")


def spanning_links(sets, comps, percent):
    """Positions (i, j) of links that hold together what all links among `sets` would, with those inside `comps`.

    Sets are met in the order of their sizes. Each is compared with the earlier ones of other components whose size and bitmap
    leave a link possible, the likeliest first.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    label = np.unique(np.asarray(comps)[order], return_inverse=True)[1]
    width = 4 * width_of(sizes[-1]) if len(sizes) else 0
    maps = np.stack([np.frombuffer(bitmap(sets[k], width), np.uint64) for k in order]) if len(sizes) else None
    hidden = sizes - np.bitwise_count(maps).sum(1).astype(np.int64) if len(sizes) else None
    found = []
    for i in range(len(sizes)):
        begin = np.searchsorted(sizes, -(-percent * sizes[i] // 100))
        near = np.arange(begin, i)
        near = near[label[near] != label[i]]
        most = np.concatenate([np.bitwise_count(maps[near[k:k + 1024]] & maps[i]).sum(1, dtype=np.int64)
                               for k in range(0, len(near), 1024)] or [near]) + np.minimum(hidden[near], hidden[i])
        near, most = (x[most >= need(sizes[near], sizes[i], percent)] for x in (near, most))
        near = near[np.argsort(-most, kind="stable")]
        while len(near):
            j, near = near[0], near[1:]
            x, y = sets[order[i]], sets[order[j]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                found.append((order[i], order[j]))
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
    return found


def _crowded_links(members, base, percent):
    """Links (a, b) that hold together what all links inside each part of `_walk_blocks` would, decided on the whole sets."""
    keys = ["hub", "left", "right", "part"]
    sets = _sets(base, bloom(members, "a")).withColumnRenamed("_id", "a")
    # Rows of one id and several texts are all members; each text links its own.
    rows = (members.join(sets, "a").select(*keys, "a", "comp", "tokens")
            .repartition(*keys).sortWithinPartitions(*keys, "a"))

    def finish(group):
        ids, comps, sets = group
        return [(ids[i], ids[j]) for i, j in spanning_links([np.frombuffer(s, np.uint64) for s in sets], comps, percent)]

    def run(batches):
        key, group = None, None
        for batch in batches:
            found = []
            for *own, i, comp, tokens in zip(*(batch.column(c).to_pylist() for c in (*keys, "a", "comp", "tokens"))):
                if own != key:
                    if group:
                        found += finish(group)
                    key, group = own, ([], [], [])
                for to, value in zip(group, (i, comp, tokens)):
                    to.append(value)
            yield links(found)
        if group:
            yield links(finish(group))

    def links(found):
        return pa.RecordBatch.from_pydict({"a": pa.array([min(f) for f in found], pa.int64()),
                                           "b": pa.array([max(f) for f in found], pa.int64())})

    return rows.mapInArrow(run, "a long, b long")


def blocks(base, representatives, percent):
    """(token, id, n, classes, hub): the prefix rows of class representatives whose token is shared.

    `hub` is a struct of the block's fixed member (a pseudo-random one) and its size.
    """
    counts = materialise(_prefix_rows(base, percent).groupBy("token").agg(F.count("*").alias("n_rows"))
                         .filter("n_rows > 1").select("token"), "tokens")
    rows = (_prefix_rows(base, percent, bloom(counts, "token"))
            .join(representatives, "_id", "left_semi").join(counts, "token", "left_semi")
            .select("token", F.col("_id").alias("id"), "n").distinct())
    rows = materialise(rows, "block-rows")
    hubs = rows.groupBy("token").agg(
        F.count("*").alias("classes"),
        F.min(F.struct(F.xxhash64("id").alias("rank"), F.col("id"), F.col("n"))).alias("hub"))
    return materialise(rows.join(hubs.filter("classes > 1"), "token"), "blocks")


def _similar_sizes(a, b, percent):
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


def _hub_pairs(found, percent):
    return (found.filter(F.col("id") != F.col("hub.id")).filter(_similar_sizes("n", "hub.n", percent))
            .select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct())


def _groups(found, percent, hot):
    """(hub, id, n): the members of the blocks that have one hub; of hot blocks the full members only."""
    room = F.least(F.lit(8) + F.floor(F.col("n") / 20), F.ceil(F.col("n") * percent / 100) - 1)
    full = (found.filter(F.col("classes") > hot).groupBy("id", "n").agg(F.count("*").alias("n_hot"))
            .filter(10 * F.col("n_hot") > 7 * room).select("id"))
    is_hot = F.col("classes") > hot
    columns = [F.col("hub.id").alias("hub"), "id", "n"]
    return (found.filter(~is_hot).select(*columns)
            .unionByName(found.filter(is_hot).select(*columns).join(full, "id", "left_semi")).distinct())


def _open_groups(groups, comps):
    """(hub, id, n, comp, members, total) of the groups that hold several components; `total` is the sum of n."""
    rows = (groups.join(comps, "id", "left")
            .select("hub", "id", "n", F.coalesce("component", "id").alias("comp")))
    several = (rows.groupBy("hub").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"),
                                       F.count("*").alias("members"), F.sum("n").alias("total"))
               .filter("c0 <> c1").select("hub", "members", "total"))
    return rows.join(several, "hub")


def _with_hubs(rows, most=32):
    """`rows` with the sorted hubs of a member's groups; null for a member of more than `most`.

    Two members are paired in the first group they share. Where a list is missing they are paired in
    each shared group; later steps drop the repeats.
    """
    lists = rows.groupBy("id").agg(F.collect_set("hub").alias("hubs"))
    lists = lists.withColumn("hubs", F.when(F.size("hubs") <= most, F.array_sort("hubs")))
    return rows.join(lists, "id")


def _dealt(rows, piece):
    """Groups dealt into pieces (hub, left, right), a member once for each pair of pieces, on its `side`.

    A piece holds about `piece` members and `PIECE_TOKENS` tokens, as one task may hold the sets of two pieces.
    """
    pieces = F.ceil(F.greatest(F.col("members") / piece, F.col("total") / PIECE_TOKENS)).cast("int")
    pieces = F.least(pieces, F.col("members")).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    return (rows.withColumn("pieces", pieces).withColumn("own", own).withColumn("other", other)
            .select("hub", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                    (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "comp", "hubs"))


@in_small_batches
def near_duplicates(docs, text="text", key="doc_id", percent=80, hot=64, piece=2048,
                    large=8):
    """(key, copy, n_shingles, class_id, component_id) per row of `docs`.

    `large`: groups up to this size send all pairs that the walk leaves; it changes the work and not the result.
    """
    body = F.col(f"`{text}`")
    base = docs.select(F.col(f"`{key}`").cast("long").alias("_id"), F.xxhash64(body).alias("_copy"),
                       body.alias("_text"))
    described = materialise(describe(base), "sets")
    base, live = base.filter("_id IS NOT NULL"), described.filter("n > 0 AND _id IS NOT NULL")
    classes = materialise(live.groupBy("d1", "d2").agg(F.min("_id").alias("class_id")), "classes")
    found = blocks(base, classes.select(F.col("class_id").alias("_id")), percent)
    maps = live.select("_id", "n", "map")

    hubs = materialise(_not_ruled_out(_hub_pairs(found, percent), maps, percent), "hub-pairs")
    stars = materialise(verify(hubs, base, percent), "stars")
    groups = materialise(_groups(found, percent, hot), "groups")
    rows = materialise(_open_groups(groups, components(stars)), "open-groups")

    rows = _dealt(_with_hubs(rows), piece)
    walk = (rows.join(maps.select(F.col("_id").alias("id"), "map"), "id")
            .repartition("hub", "left", "right").sortWithinPartitions("hub", "left", "right", "id"))
    walked = materialise(_walk_blocks(walk, percent, large), "walked")
    pairs = materialise(walked.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .distinct(), "pairs")
    links = stars.unionByName(materialise(verify(pairs, base, percent), "links"))
    members = walked.filter("b IS NULL").drop("b")
    if not members.isEmpty():
        links = links.unionByName(materialise(_crowded_links(members, base, percent), "crowded-links"))
    comps = components(links).withColumnRenamed("id", "class_id")

    rows = (described.join(classes, ["d1", "d2"], "left")
            .select("_id", "_copy", "n", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("_id"))
                    .alias("class_id")))
    return rows.join(comps, "class_id", "left").select(
        F.col("_id").alias(key), F.col("_copy").alias("copy"), F.col("n").alias("n_shingles"), "class_id",
        F.coalesce("component", "class_id").alias("component_id"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words
          UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM least LEFT JOIN sizes USING (doc_id)"""
