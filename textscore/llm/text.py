"""Whole texts in Arrow batches: words as 64-bit hashes, and what the operators share.

A word is a run of bytes other than space and 0x09-0x0D. Texts arrive as UTF-8 bytes, so ASCII
lower-casing touches A-Z alone. Tasks cut a batch into slices of about `SLICE` bytes of text, which
bounds their memory whatever the number of rows; one longer text is a slice of its own.
"""

import functools

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

SLICE = 1 << 20
BATCH = "4m"


def mix(x):
    """A 64-bit finaliser (xor-shift and multiply), on arrays of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stream(seed, size):
    """Fixed odd-looking numbers from a counter, the same in every process."""
    steps = (seed + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return mix(steps.astype(np.uint64))


_PLACES = _stream(np.uint64(7), 4096) | np.uint64(1)
_BYTES = _stream(np.uint64(11), 256)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


class Words:
    """The words of some texts: `start`, `end` (bytes in `data`), `text` (index), `hash`."""

    def __init__(self, texts, lower=True, hashed=True):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.offset = np.concatenate([[0], np.cumsum(lengths + 1)])
        inside = ~SPACE[self.data]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        # Words per text; words of a text are consecutive.
        self.first = np.searchsorted(self.start, self.offset)
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(texts)), self.count)
        self.hash = hash_spans(self.data, self.start, self.end, lower) if hashed else None


def hash_spans(data, start, end, lower=False):
    """Multilinear hash of the bytes [start, end) of each span; an empty span has 0 bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    at = np.repeat(start, length) + place
    table = _LOWER if lower else _BYTES
    terms = table[data[at]] * (_PLACES[place & 4095] + (place >> 12).astype(np.uint64))
    total = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    sums = total[begin + length] - total[begin]
    return mix(sums + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def combine(hashes, width):
    """Hash of each run of `width` consecutive values; runs cross no border the caller keeps."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k:k + n]
    return mix(out)


def as_bytes(column):
    """The values of an Arrow text column as bytes; a null is an empty text."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def slices(batch, column, limit=SLICE):
    """Cut a batch into (rows, texts) of about `limit` bytes of text."""
    lengths = batch.column(column).cast(pa.binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(lengths), 0))
    begin = size = 0
    for i, n in enumerate(sizes):
        if i > begin and size + n > limit:
            rows = batch.slice(begin, i - begin)
            yield rows, as_bytes(rows.column(column))
            begin, size = i, 0
        size += int(n)
    if batch.num_rows > begin:
        rows = batch.slice(begin)
        yield rows, as_bytes(rows.column(column))


def in_small_batches(operator):
    """An operator on a table whose Arrow batches hold about `BATCH` bytes each, where rows of sets or codes may be long.

    A batch lies in memory in the executor and in its Python worker at once. The session's own limit is put back at the end,
    so this covers what the operator has run by then, not a table it returns unread.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"

    @functools.wraps(operator)
    def held(table, *args, **kwargs):
        conf = table.sparkSession.conf
        before = conf.get(limit, None)
        conf.set(limit, BATCH)
        try:
            return operator(table, *args, **kwargs)
        finally:
            conf.unset(limit) if before is None else conf.set(limit, before)

    return held


def over_texts(df, column, schema, work, keep=()):
    """Apply `work(texts) -> dict of columns` to slices of texts; the `keep` columns stay.

    `schema` names the new columns. Only the text and the kept columns travel to Python.
    """
    kept = [f for f in df.schema if f.name in keep]
    names = [f.name for f in kept]
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [schema])

    def run(batches):
        for batch in batches:
            for rows, texts in slices(batch, column):
                made = work(texts)
                yield pa.RecordBatch.from_pydict(
                    {**{n: rows.column(n) for n in names},
                     **{k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in made.items()}})

    picked = df.select(*dict.fromkeys([*names, column]))
    return picked.mapInArrow(run, out)


def without(df, *names):
    """`df` without the columns that a result is about to add (compared without case)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def unused(df, *names):
    """The names, each with underscores put before it until `df` has no such column (compared without case)."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column, modulus):
    """crc32 of the value as text, modulo; null counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
