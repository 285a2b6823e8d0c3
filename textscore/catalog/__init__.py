"""Every operator as a query on the shared test tables, with the SQL that checks it."""

from textscore.catalog import airings, cleaning, models, text, vocabulary

MODULES = (cleaning, airings, text, vocabulary, models)


def queries():
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
