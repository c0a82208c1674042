"""Every query of the catalogue against its oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from siftwell.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(round(float(r[i]), 5) if isinstance(r[i], float) else r[i] for i in order) for r in values) if values and not any(v is None for r in values for v in r) else sorted((tuple(round(float(r[i]), 5) if isinstance(r[i], float) else r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_oracle(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    found = oracle.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(columns, found.fetchall())
    assert got == want and got


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_entry_without_the_corpus_operators(spark):
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
