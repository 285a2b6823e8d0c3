"""Benchmark decontamination by template canonicalisation.

Words lose their outer ASCII punctuation and A-Z is lower-cased. Numbers, names and units become
typed placeholders: a number is a word of digits with inner `.,:/-` or `%`; a name is a capitalised
word that does not open a sentence; a unit is one of a fixed list after a number. The hash of each
window of `width` canonical words joins texts with benchmark items. A window of fewer than `literals` words that are
not placeholders, such as a row of numbers, says too little as a template: its words join as they are. An item of
fewer than `width` words, `least` or more, is one window of its own words. A joined pair is then checked for slot consistency: within one alignment of a text
with an item, a slot value of the item must always stand for one value of the text and the other way
round, so a re-parameterised question matches and a chance meeting of two templates does not. A text
is contaminated by an item when consistent windows are at least one, and at least `share` of the
item's windows.

Texts are hashed in Arrow batches. A Bloom filter of fixed size, built from all benchmark
windows, keeps windows that cannot match from being shuffled; the hash join decides.

Defined results: null or empty texts and items match nothing, nor do items of fewer than `least` words, which
cannot be told from chance. Repeated rows of an item are one item. Different texts under one item id are compared one by one, and the one with the most
matched windows (of those the shortest) counts. Rows equal in id and text are one document. Extra columns stay out of the
matches.
"""

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from textscore.llm.text import Words, combine, hash_spans, mix, slices, unused
from textscore.operators.joins import lookup_join

BLOOM_BITS = 1 << 24
PROBES = 3
# Unit words that stand for <unit> after a number.
UNITS = ("km m cm mm mile miles foot feet inch inches kg g mg lb lbs pound pounds ounce ounces litre "
         "litres liter liters ml gallon gallons second seconds minute minutes hour hours day days week "
         "weeks month months year years dollar dollars cent cents euro euros usd eur gbp percent "
         "degree degrees kb mb gb tb hz khz mhz ghz watt watts volt volts").split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x4E554D42, 0x4E414D45, 0x554E4954))

_KIND = np.zeros(256, np.uint8)          # 1 digit, 2 upper-case letter, 4 outer punctuation, 8 inside numbers
_KIND[48:58] = 1
_KIND[65:91] = 2
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _KIND[_b] |= 4
for _b in b".,:/-%":
    _KIND[_b] |= 8


def _unit_hashes():
    return np.sort(Words([w.encode() for w in UNITS]).hash)


class Canonical:
    """Canonical words of some texts: `value` (own hash), `form` (hash or placeholder), `slot`, `text`."""

    def __init__(self, texts):
        words = Words(texts, hashed=False)
        data, start, end, owner = words.data, words.start.copy(), words.end.copy(), words.text
        kind = _KIND[data]
        ends = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8)) if len(end) else np.zeros(0, bool)
        # The data end with a line break, so each word has a place at or after its start that is no punctuation.
        solid = np.flatnonzero(kind & 4 == 0)
        start = solid[np.searchsorted(solid, start)]
        keep = start < end
        end = np.where(keep, solid[np.maximum(np.searchsorted(solid, end) - 1, 0)] + 1, start)
        opens = np.ones(len(start), bool)
        if len(start) > 1:
            opens[1:] = ends[:-1] | (owner[1:] != owner[:-1])
        start, end, owner, opens = start[keep], end[keep], owner[keep], opens[keep]
        self.text, self.count = owner, np.bincount(owner, minlength=len(texts))
        self.value = hash_spans(data, start, end, lower=True)
        running = lambda flag: np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        digits, inner = running(kind & 1), running((kind & 9) > 0)
        number = (digits[end] > digits[start]) & (inner[end] - inner[start] == end - start)
        name = (kind[start] & 2 > 0) & ~opens if len(start) else np.zeros(0, bool)
        after = np.zeros(len(start), bool)
        after[1:] = number[:-1] & (owner[1:] == owner[:-1])
        unit = after & np.isin(self.value, _unit_hashes())
        self.slot = number | name | unit
        self.form = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, self.value)))


def _windows(texts, width, literals, short=None, least=0):
    """(canonical, start, text, hash, words, plain) of all windows inside one text, `plain` if its words join as they are.

    `short` lists the lengths below `width` of windows that are looked for; without it a text of `least`
    words or more and fewer than `width` is one window.
    """
    c = Canonical(texts)
    literal = np.concatenate([[0], np.cumsum(~c.slot)])
    forms, values = combine(c.form, width), combine(c.value, width)
    n = len(forms)
    at = np.flatnonzero(c.text[:n] == c.text[width - 1:]) if n else np.zeros(0, np.int64)
    plain = literal[at + width] - literal[at] < literals
    parts = [(at, np.where(plain, mix(values[at]), forms[at]), np.full(len(at), width), plain)]
    first = np.concatenate([[0], np.cumsum(c.count)])
    for w in range(least, width) if short is None else short:
        values = combine(c.value, w)
        if short is None:
            at = first[:-1][c.count == w]
        else:
            at = np.flatnonzero(c.text[:len(values)] == c.text[w - 1:]) if len(values) else np.zeros(0, np.int64)
        parts.append((at, mix(values[at]) if len(at) else values[:0], np.full(len(at), w), np.ones(len(at), bool)))
    at, hashes, words, plain = (np.concatenate(x) for x in zip(*parts))
    return c, at, c.text[at], hashes, words, plain


def _probes(hashes):
    return [(mix(hashes + np.uint64(k)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for k in range(PROBES)]


_SCHEMA = "h long, at int, words int, slots array<int>, values array<long>"


def _rows(df, key, width, literals, bloom=None, short=None, least=0):
    """Windows of a table: hash, word position, length, and the offsets and values of its slots (none if joined as they are)."""
    field = next(f for f in df.schema if f.name == key)

    def run(batches):
        bits = None if bloom is None else np.unpackbits(np.frombuffer(bloom.value, np.uint8)).view(bool)
        for batch in batches:
            for rows, texts in slices(batch, "_text"):
                c, at, text, hashes, words, plain = _windows(texts, width, literals, short, least)
                if bits is not None:
                    hit = np.ones(len(hashes), bool)
                    for p in _probes(hashes):
                        hit[hit] = bits[p[hit]]
                    at, text, hashes, words, plain = (x[hit] for x in (at, text, hashes, words, plain))
                first = np.concatenate([[0], np.cumsum(c.count)])
                places = [np.flatnonzero(c.slot[a:a + width] & ~p) for a, p in zip(at, plain)]
                yield pa.RecordBatch.from_pydict({
                    key: rows.column(key).take(pa.array(text)),
                    "copy": rows.column("copy").take(pa.array(text)),
                    "h": pa.array(hashes.view(np.int64)),
                    "at": pa.array((at - first[text]).astype(np.int32)), "words": pa.array(words.astype(np.int32)),
                    "slots": pa.array([p.astype(np.int32) for p in places], pa.list_(pa.int32())),
                    "values": pa.array([c.value[a + p].view(np.int64) for a, p in zip(at, places)],
                                       pa.list_(pa.int64()))})

    return df.mapInArrow(run, f"`{key}` {field.dataType.simpleString()}, copy long, {_SCHEMA}")


def _bloom(spark, hashes):
    """The fixed-size bitmap of all benchmark windows: set words of 32 bits, OR-ed by Spark."""
    def run(batches):
        for batch in batches:
            h = np.asarray(batch.column("h")).view(np.uint64)
            spots = np.unique(np.concatenate(_probes(h))) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_pydict({"word": pa.array(spots >> 5),
                                              "bit": pa.array(np.int64(1) << (spots & 31))})

    words = (hashes.mapInArrow(run, "word long, bit long").groupBy("word")
             .agg(F.bit_or("bit").alias("bits")).toArrow())
    bits = np.zeros(BLOOM_BITS // 32, np.uint32)
    bits[np.asarray(words["word"])] = np.asarray(words["bits"]).astype(np.uint32)
    # unpackbits reads the most significant bit first; bit k of word w is position 32 w + k.
    packed = np.packbits(np.unpackbits(bits.view(np.uint8), bitorder="little"))
    return spark.sparkContext.broadcast(packed.tobytes())


def matches(docs, benchmark, text="text", key="doc_id", item_text="text", item_key="item_id",
            width=10, literals=6, least=5, share=0.0):
    """(key, copy, item_id, n_windows, item_windows): consistent matches of texts with items."""
    spark = docs.sparkSession
    left = docs.select(F.col(f"`{key}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    left = left.withColumn("copy", F.xxhash64("_text"))
    right = benchmark.select(F.col(f"`{item_key}`").alias("_item"), F.col(f"`{item_text}`").alias("_text"))
    items = _rows(right.withColumn("copy", F.xxhash64("_text")), "_item", width, literals, least=least)
    # The lengths of short items: numbers below `width`.
    short = [r[0] for r in items.filter(F.col("words") < width).select("words").distinct().orderBy("words").collect()]
    bloom = _bloom(spark, items.select("h"))
    found = _rows(left, "_doc", width, literals, bloom, short)
    item = items.select("_item", F.col("copy").alias("item_copy"), "h", F.col("at").alias("item_at"),
                        F.col("values").alias("item_values"))
    pairs = lookup_join(found, item, "h", "inner", spread=["_doc", "at"])
    # An alignment: one text, one text of an item, one distance between their positions. It holds each
    # position of the item once, so what is gathered here is bounded by the item's length.
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    spots = (pairs.groupBy("_doc", "copy", "_item", "item_copy", shift)
             .agg(F.collect_set("item_at").alias("ats"),
                  F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("values", "item_values"))))
                  .alias("slots")))
    one_to_one = ((F.size(F.array_distinct("slots.values")) == F.size("slots"))
                  & (F.size(F.array_distinct("slots.item_values")) == F.size("slots")))
    hits = (spots.filter(one_to_one).groupBy("_doc", "copy", "_item", "item_copy")
            .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("n_windows")))
    sizes = items.groupBy(F.col("_item").alias("_sized"), F.col("copy").alias("_sized_copy")).agg(
        F.countDistinct("at").alias("item_windows"))
    own = F.col("_item").eqNullSafe(F.col("_sized")) & (F.col("item_copy") == F.col("_sized_copy"))
    best = F.max(F.struct("n_windows", (-F.col("item_windows")).alias("size"))).alias("best")
    return (hits.join(sizes, own).filter(F.col("n_windows") >= share * F.col("item_windows"))
            .groupBy("_doc", "copy", "_item").agg(best)
            .select(F.col("_doc").alias(key), "copy", F.col("_item").alias(item_key),
                    "best.n_windows", (-F.col("best.size")).alias("item_windows")))


def remove_contaminated(docs, benchmark, text="text", key="doc_id", **options):
    """`docs` without the rows that match an item; all else as it was."""
    doc, copy = unused(docs, "_doc", "_copy")
    found = matches(docs, benchmark, text, key, **options).select(key, "copy").distinct().toDF(doc, copy)
    same = (F.col(f"`{key}`").eqNullSafe(F.col(doc))
            & (F.xxhash64(F.col(f"`{text}`")) == F.col(copy)))
    return docs.join(found, same, "left_anti")
