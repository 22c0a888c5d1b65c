"""Benchmark items without an id: their words are hit and removed, as the SQL has it."""

import duckdb
import pytest
from cases import ordered
from test_decontaminate import ITEMS, random_case

from marketpulse.llm import decontaminate
from marketpulse.llm.oracle import ORACLE

ROWS = [(None, "alpha beta"), (None, "gamma delta"), (7, "alpha beta"), (8, "epsilon zeta")]
DOCS = [(1, "see alpha beta here"), (2, "gamma delta and alpha beta"), (3, "clean"), (4, "gamma delta")]


def by_sql(docs, items):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    return ordered(con.sql(ORACLE["op4_decontamination"]).fetchall())


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_random_case_equals_sql(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs, items = random_case()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.report(frame, spark.createDataFrame([(*i, None) for i in items], ITEMS))
    assert ordered(got.collect()) == by_sql(docs, items)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 30])
def test_hit_and_removed(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in DOCS], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(*r, None) for r in ROWS], ITEMS)
    got = decontaminate.report(docs, items).collect()
    assert ordered(got) == by_sql(DOCS, ROWS)
    assert {r.doc_id: (r.n_hit, r.n_items) for r in got} == {1: (2, 2), 2: (4, 2), 3: (0, 0), 4: (2, 1)}
    kept = {r.doc_id: r.text for r in decontaminate.remove(docs, items).collect()}
    assert kept == {1: "see  here", 2: " and ", 3: "clean"}
