"""Joins of a large table with a dimension, safe against hot keys."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

# A broadcast is built whole in the driver, at several times the bytes of its rows.
BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 4 * 2 ** 20
# A dimension up to this size is hashed by key, its part in each task; even one hot key of it fits there.
HASH_BYTES = 64 * 2 ** 20
SALTS = 32
PACKED_ROWS = 1 << 14


def has_at_most(df, rows, size=128 * 2 ** 20):
    """Whether `df` has at most so many rows and bytes, by one sum over all its partitions."""
    found = rows_and_bytes(df)
    return found[0] <= rows and found[1] <= size


def rows_and_bytes(df):
    """The rows and about the bytes of `df`."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0))
             for f in df.schema if f.dataType.typeName() in ("string", "struct", "array", "map")]
    fixed = F.lit(16 * len(df.columns))
    return tuple(df.agg(F.count("*"), F.coalesce(F.sum(reduce(add, texts, fixed)), F.lit(0))).first())


def lookup_join(big, dim, on, how="left", spread=None, max_rows=BROADCAST_ROWS, salts=SALTS):
    """Join `big` with `dim` on equal `on` columns.

    A dimension within `max_rows` rows and `BROADCAST_BYTES` is broadcast. A larger one is joined by shuffle, each
    key of `big` dealt over `salts` partitions by the hash of its `spread` columns and `dim`
    repeated as often, so one key with a third of all rows does not end in one task. Within `HASH_BYTES` the dimension is
    hashed and the rows of `big`, which may be long, pass by unsorted; beyond that both sides are sorted. With `salts=1`, for keys known not
    to be hot, nothing is dealt or repeated, and further joins on the key move no rows.
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup_join keeps the large side: use left or inner")
    on = [on] if isinstance(on, str) else list(on)
    rows, size = rows_and_bytes(dim)
    if rows <= max_rows and size <= BROADCAST_BYTES:
        return big.join(F.broadcast(dim), on, how)
    if salts == 1:
        return big.join(dim.hint("merge"), on, how)
    spread = spread or [c for c in big.columns if c not in on]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated.hint("shuffle_hash" if size <= HASH_BYTES else "merge"), [*on, "_salt"], how).drop("_salt")


def packed(dim, on, columns, name="_rows"):
    """(on, `name`): the `columns` of all rows of a key in arrays, for joins that repeat the large side many times.

    Such a join finds a few arrays where it would look up each row, and reading them out goes through memory in order.
    Rows are dealt over arrays by the hash of all their columns, so one array has about `PACKED_ROWS` rows at most, but for equal
    rows, which stay together: if that makes one four times as long, None is returned, and the rows are to be joined as they are.
    Arrays are sorted: equal values come in runs, and the order does not hang on the shuffle.
    """
    on = [on] if isinstance(on, str) else list(on)
    parts = -(-max(dim.count(), 1) // PACKED_ROWS)
    dealt = dim.withColumn("_part", F.pmod(F.xxhash64(*dim.columns), F.lit(parts))).groupBy(*on, "_part")
    if (dealt.agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 4 * PACKED_ROWS:
        return None
    return dealt.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name)).drop("_part")


def unpacked(df, name="_rows"):
    """A row for each element of the arrays of `packed`."""
    return df.select(*[c for c in df.columns if c != name], F.inline(name))


def likely_in(big, dim, on, bits=16):
    """The rows of `big` whose `on` columns are in `dim`, and about one in `bits` of the others.

    A table of bits, `bits` for each of the distinct rows of `dim`, is broadcast, so dimensions too long for a broadcast
    still keep most rows from being moved; an exact join has to follow.
    """
    blocks = max(-(-dim.count() * bits // 1024), 1)
    at = F.pmod(F.xxhash64(*on), F.lit(blocks * 1024).cast("bigint"))
    placed = dim.select(at.alias("at")).select(
        F.floor(F.col("at") / 1024).alias("_block"), F.expr("cast(at div 64 % 16 as int)").alias("word"),
        F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
    words = [F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("bigint")) for w in range(16)]
    table = placed.groupBy("_block").agg(F.array(*words).alias("_words"))
    marked = big.withColumn("_at", at).withColumn("_block", F.floor(F.col("_at") / 1024))
    found = F.expr("getbit(get(_words, cast(_at div 64 % 16 as int)), cast(_at % 64 as int)) = 1")
    return marked.join(F.broadcast(table), "_block").where(found).select(*big.columns)


def null_safe_key(df, column, name="_match"):
    """A key under which NULL equals NULL, for joins that must match missing keys."""
    return df.withColumn(name, F.struct(F.col(column).isNull().alias("missing"),
                                        F.coalesce(F.col(column), F.lit("")).alias("value")))
