"""Positions and identity of ledger rows: nothing vanishes, nothing is summed twice."""

from dataclasses import replace
from datetime import date

import pytest
from helpers import MED1, ODO1, FrameInputs, rows

from marketpulse.plans import finance, pipeline
from marketpulse.sources.files import LedgerFiles
from marketpulse.sources.inputs import Replaced
from marketpulse.sources.ledger import read_long, read_wide, unite

ACCOUNTS = [a.conta for a in ODO1.accounts]
WIDE = "registro string, ano_tri string, " + ", ".join(f"{a} double" for a in ACCOUNTS)
Q2 = date(2021, 4, 1)


def wide(spark, *cells, columns=WIDE):
    return spark.createDataFrame([(r, "2021 Q2", *c) for r, *c in cells], columns)


def result(inputs, spec, ledger):
    table = finance.operating_result(Replaced(inputs, ledger=ledger), (spec,))
    return {r.registro: r.res_op for r in table.collect()}


def test_an_all_empty_row_keeps_its_position(spark):
    none = [None] * len(ACCOUNTS)
    ledger = read_wide(wide(spark, ("5", 10.0, -1.0, 0.0, 4.0), ("6", *none), ("7", 10.0, None, 0.0, 4.0)), (ODO1,))
    empty = [r for r in rows(ledger) if r[1] == "6"]
    assert empty == [("ODO", "6", None, Q2, None, None)]
    assert ledger.count() == 4 + 1 + 3
    assert result(FrameInputs(spark), ODO1, ledger) == {"5": 500, "6": None, "7": None}


def test_of_cells_that_are_no_amount(spark):
    """A dash is an empty cell as well."""
    raw = spark.createDataFrame([("6", "2021 Q2", "-", "-")], "registro string, ano_tri string, " + ", ".join(f"{a} string" for a in ACCOUNTS[:2]))
    assert rows(read_wide(raw, (ODO1,)), "registro", "class_conta", "saldo_cents") == [("6", None, None)]
    with pytest.raises(ValueError, match="is an account of"):
        read_wide(raw.select("registro", "ano_tri"), (ODO1,))


def test_a_wide_file_of_both_segments(spark):
    columns = f"registro string, ano_tri string, {ACCOUNTS[0]} double, {MED1.accounts[0].conta} double"
    ledger = read_wide(wide(spark, ("1", 2.0, None), ("2", None, 3.0), columns=columns), (MED1, ODO1))
    assert sorted(rows(ledger, "segmento", "registro", "saldo_cents"), key=repr) == sorted(
        [("MED", "1", None), ("MED", "2", 300), ("ODO", "1", 200), ("ODO", "2", None)], key=repr
    )


def test_long_rows_of_unknown_accounts_keep_their_position(spark):
    raw = spark.createDataFrame(
        [("1", "m", "2021", ACCOUNTS[0], 5.0), ("2", "m", "2021", "x", 7.0), ("2", "m", "2021", "y", 8.0), ("1", "m", "2021", "x", 1.0)],
        "registro string, modalidade string, ano string, class_conta string, saldo_final double",
    )
    ledger = read_long(raw, (ODO1,))
    assert sorted(rows(ledger, "registro", "class_conta", "saldo_cents"), key=repr) == sorted(
        [("1", ACCOUNTS[0], 500), ("1", None, None), ("2", None, None)], key=repr
    )
    assert result(FrameInputs(spark), ODO1, ledger) == {"1": None, "2": None}
    assert result(FrameInputs(spark), MED1, read_long(raw, (MED1,))) == {"1": 0, "2": 0}
    both = read_long(raw.filter("class_conta = 'x'"), (MED1, ODO1))
    assert sorted(rows(both, "segmento", "registro")) == [("MED", "1"), ("MED", "2"), ("ODO", "1"), ("ODO", "2")]


def test_positions_survive_landing(spark, tmp_path):
    none = [None] * len(ACCOUNTS)
    path = f"file://{tmp_path}/wide.parquet"
    wide(spark, ("5", 10.0, -1.0, 0.0, 4.0), ("6", *none)).write.parquet(path)
    long = f"file://{tmp_path}/long.parquet"
    spark.createDataFrame(
        [("6", None, "2021 Q2", "unknown", 1.0), ("8", None, "2021 Q2", "unknown", 1.0)],
        "registro string, modalidade string, ano string, class_conta string, saldo_final double",
    ).write.parquet(long)
    files = [LedgerFiles((path,), "wide", (ODO1,)), LedgerFiles((long,), "long", (ODO1,))]
    landed = pipeline.land_files(spark, f"file://{tmp_path}/landed", {}, [], files)
    got = finance.operating_result(landed, (ODO1,))
    assert sorted(rows(got, "registro", "ano", "res_op"), key=repr) == [("5", 2021, 500), ("6", 2021, None), ("8", 2021, None)]
    pipeline.land_ledger(landed, (ODO1,), f"file://{tmp_path}/again")
    again = spark.read.parquet(f"file://{tmp_path}/again/ledger")
    assert sorted(rows(again, "registro", "class_conta"), key=repr).count(("6", None)) == 1
    year = finance.finance_year(landed, (replace(ODO1, money_unit=1.0),))
    assert rows(year, "ano", "resultado_operacional") == [(2021, 5.0)]


def test_a_row_given_twice_is_an_error(spark, tmp_path):
    paths = []
    for name, cell in (("a", 10.0), ("b", 11.0)):
        paths.append(f"file://{tmp_path}/{name}.parquet")
        wide(spark, ("5", cell, -1.0, 0.0, 4.0)).write.parquet(paths[-1])
    with pytest.raises(Exception, match=f"a ledger row is given twice: ODO, 5, \\?, 2021-04-01, .*{ACCOUNTS[0][:10]}|given twice: ODO, 5"):
        files = [LedgerFiles((p,), "wide", (ODO1,)) for p in paths]
        pipeline.land_files(spark, f"file://{tmp_path}/landed", {}, [], files)
    one = read_wide(wide(spark, ("5", 10.0, None, None, None)), (ODO1,))
    other = read_wide(wide(spark, ("5", None, 4.0, None, None)), (ODO1,))
    assert sorted(r[-1] for r in rows(unite([one, other]))) == [400, 1000]
    with pytest.raises(Exception, match="given twice"):  # within one file as well, and whatever the amounts
        unite([read_wide(wide(spark, ("5", 1.0, None, None, None), ("5", 1.0, None, None, None)), (ODO1,))]).collect()
