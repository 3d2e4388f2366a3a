"""Queries against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from gleaner.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


def table(rows, names):
    order = sorted(names)
    return order, sorted((tuple(plain(r[names.index(n)]) for n in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    expected = duck.sql(catalog.ORACLES[name])
    assert table(df.collect(), df.columns) == table(expected.fetchall(), expected.columns)


def test_every_query_without_sql_is_a_known_one():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"bpe_train", "bpe_train_documents", "bpe_pretokenized", "longest_palindrome_documents", "longest_repeat_of_documents", "minhash_accuracy"}
