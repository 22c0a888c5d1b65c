"""Every registered query against its SQL on the same tables."""

import datetime
import decimal

import pytest
from helpers import MIDDLE, SMALL, oracle

import __spark_entry__ as registered

# The optional subpackage has tests of its own for its queries.
QUERIES = {n: q for n, q in registered.queries().items() if n.startswith("q")}
SQL = {n: q for n, q in registered.oracle_sql().items() if n.startswith("q")}
READERS = ("43", "44", "45", "46", "47")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "date": "DATE"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_flagship(spark):
    assert registered.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    return oracle(SMALL)


@pytest.fixture(scope="module")
def larger():
    return oracle(MIDDLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    same_rows(spark, SMALL, duck, name)


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n[1:3] in READERS])
def test_same_rows_where_positions_are_empty(spark, larger, name):
    """The smallest tables have no position without accounts of its own."""
    same_rows(spark, MIDDLE, larger, name)


def same_rows(spark, directory, duck, name):
    df = QUERIES[name](spark, directory)
    rel = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    stored = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: TYPES[t] for c, t in df.dtypes} == stored
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    place = [rel.columns.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in place) for r in rel.fetchall()), key=repr)
    assert got == expected
    assert got
    kinds = (str, int, float, datetime.date, type(None))
    assert all(isinstance(v, kinds) and not isinstance(v, decimal.Decimal) for r in got for v in r)
