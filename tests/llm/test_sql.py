"""Queries of the subpackage against their SQL on the same tables."""

import duckdb
import pytest

from marketpulse.llm import registry

FOLDER = "/root/testdata/sf0.01"
NAMES = {f"op{n}" for n in range(1, 14)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_one_query_for_each_operator():
    assert {n.split("_")[0] for n in registry.QUERIES} == {*NAMES, "pipeline"}
    assert len(registry.QUERIES) == 14 and set(registry.ORACLE) < set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, duck, name):
    df, rel = registry.QUERIES[name](spark, FOLDER), duck.sql(registry.ORACLE[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    assert {c: kinds[t] for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[k] for k in at) for r in rel.fetchall()), key=repr)
    assert len(got) == 1000 or name == "op11_spelling_variants" and len(got) > 1000
