"""First row or first value per key as map-side combinable aggregates."""

from pyspark.sql import functions as F


def order_struct(order):
    """Sort key with NULLs last; `-column` in `order` means descending (numbers, dates)."""
    fields = []
    for k, name in enumerate(order):
        c = F.col(name.lstrip("-"))
        if name.startswith("-"):
            fields += [c.isNull().alias(f"n{k}"), (-c).alias(f"k{k}")]
        else:
            fields += [c.isNull().alias(f"n{k}"), c.alias(f"k{k}")]
    return F.struct(*fields)


def first_per_key(df, keys, order):
    """One whole row per key: the first in `order`."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), order_struct(order))
    picked = df.groupBy(*keys).agg(row.alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def first_value(column, order):
    """Aggregate: first non-NULL value of `column` in `order`."""
    c = F.col(f"`{column}`")
    return F.min_by(c, F.when(c.isNotNull(), order_struct(order)))
