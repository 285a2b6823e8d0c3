"""Compare every query with its SQL in DuckDB: `python tests/compare.py SF_DIR [name ...]`."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return "\0" if value is None else f"{type(value).__name__}:{value}"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql):
    """What differs, as text; empty if nothing does."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    expected = canonical(columns, cursor.fetchall())
    actual = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    wrong = [(a, e) for a, e in zip(actual, expected) if a != e]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""


if __name__ == "__main__":
    from textscore import catalog
    from textscore.session import session

    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, oracles = connect(sf_dir), catalog.oracle_sql()
    for name, run in catalog.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                outcome = differences(df, con, oracles[name]) or "equal"
            else:
                outcome = f"{len(df.collect())} rows, no SQL"
        except Exception as error:  # report and go on with the next query
            outcome = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28} {time.time() - started:6.1f}s  {outcome}", flush=True)
