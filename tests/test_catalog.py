"""Every registered query runs, and gives what its SQL gives."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def cell(v):
    if isinstance(v, float) and v == int(v):
        v = int(v)
    return "" if v is None else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted([cell(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_what_its_sql_gives(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in catalog.ORACLE_SQL:
        result = duck.execute(catalog.ORACLE_SQL[name])
        columns = [d[0] for d in result.description]
        assert got == table(columns, result.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
