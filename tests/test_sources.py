"""Files as they arrive: headers, both ledger layouts, text crosstabs."""

from datetime import date

import pytest
from helpers import MED1, ODO1, Q, rows

from marketpulse.functions.names import snake, snake_all
from marketpulse.operators import crosstab
from marketpulse.plans import enrolment, modality, pipeline
from marketpulse.sources import ledger
from marketpulse.sources.extracts import Extract, read_extract
from marketpulse.sources.inputs import LandedInputs
from marketpulse.sources.members import read_members


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Cód. ANS", "cod_ans"),
        ("Número ANS", "numero_ans"),
        ("RegistroANS", "registro_ans"),
        ("  % do total ", "percent_do_total"),
        ("Não identificado", "nao_identificado"),
        ("2021", "x2021"),
        ("mar_15", "mar_15"),
        ("Mar/15", "mar_15"),
    ],
)
def test_header_cleaning(raw, clean):
    assert snake(raw) == clean


def test_colliding_headers_are_numbered():
    assert snake_all(["A b", "a_b", "A-B"]) == ["a_b", "a_b_2", "a_b_3"]


def test_member_list(spark):
    raw = spark.createDataFrame([(7, "x"), (7, "x")], "`Cod ANS` long, `Razão Social` string")
    table = read_members(raw, MED1)
    assert rows(table) == [("MED", "7", 1, "x")] * 2
    assert table.columns == ["segmento", "registro", "associada", "razao_social"]


def test_long_ledger(spark):
    raw = spark.createDataFrame(
        [
            (1, "m", "2021 Q3", "receita_de_contraprestacoes_medica", "10.55"),
            (1, "m", "2021", "despesa_assistencial_odonto", "1e3"),
            (1, "m", "2021-05-06", "despesa_administrativa", "n/d"),
            (1, "m", "2021 Q1", "conta_sem_uso", "5"),
        ],
        "Registro long, Modalidade string, Ano string, class_conta string, saldo_final string",
    )
    got = {r.class_conta: r for r in ledger.read_long(raw, (MED1, ODO1)).collect()}
    assert set(got) == {
        "receita_de_contraprestacoes_medica",
        "despesa_assistencial_odonto",
        "despesa_administrativa",
        None,  # the position of an account that no segment uses
    }
    r = got["receita_de_contraprestacoes_medica"]
    assert (r.segmento, r.registro, r.ano_tri, r.saldo_cents) == ("MED", "1", date(2021, 7, 1), 1055)
    r = got["despesa_assistencial_odonto"]
    assert (r.segmento, r.ano_tri, r.saldo_cents) == ("ODO", date(2021, 1, 1), 100000)
    r = got["despesa_administrativa"]
    assert (r.segmento, r.ano_tri, r.saldo_cents) == ("MED", date(2021, 4, 1), None)


def test_wide_ledger_gives_the_same_long_form(spark):
    a, b = ODO1.accounts[0].conta, ODO1.accounts[3].conta
    wide = spark.createDataFrame(
        [(5, "2021 Q2", "1.50", None), (6, "2021 Q2", "2", "3")],
        f"registro long, ano_tri string, {a} string, {b} string",
    )
    got = sorted(rows(ledger.read_wide(wide, (ODO1,)), "registro", "class_conta", "saldo_cents"))
    assert got == sorted([("5", a, 150), ("6", a, 200), ("6", b, 300)])


def _csv(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return f"file://{path}"


def test_operator_extracts_with_different_period_columns(spark, tmp_path):
    """Two requests; the second lists another operator and a renamed one."""
    first = _csv(tmp_path, "2015.csv", "registro,operadora,dez_15,total",
                 "1,A,10,10", "2,B,20,20", "TOTAL,TOTAL,30,30")
    second = _csv(tmp_path, "2016.csv", "registro,operadora,mar_16,total",
                  "1,A,-,0", "3,C,50,50", "2,B2,25,25", "TOTAL,TOTAL,75,75")
    cut = f"file://{tmp_path}/cut"
    extract = Extract((first, second), "competencia")
    assert read_extract(spark, extract, MED1).filter("registro = 'TOTAL'").count() == 0
    pipeline.land_extracts(spark, [(extract, MED1)], cut)
    members = f"file://{tmp_path}/members"
    spark.createDataFrame([("MED", "1", 1)], "segmento string, registro string, associada int"
                          ).write.partitionBy("segmento").parquet(members)
    inputs = LandedInputs(spark, {frozenset({"registro", "operadora"}): cut}, members, "")
    series = enrolment.market_series(inputs, (MED1,), (Q[154], Q[161])).orderBy("competencia")
    assert rows(series, "competencia", "mercado", "associadas") == [
        (Q[154], 30, 10), (Q[161], 0, 0),
    ]


def test_period_extracts_serve_the_marginal_jobs(spark, tmp_path):
    path = _csv(tmp_path, "mod.csv", "competencia,filantropia,medicina_de_grupo,total",
                "jun/21,100,200,300", "jun/22,110,220,330", "TOTAL,210,420,630")
    snapshot = _csv(tmp_path, "op.csv", "registro,operadora,autogestao,medicina_de_grupo,total",
                    "1,A,-,200,200", "2,B,130,-,130", "TOTAL,TOTAL,130,200,330")
    cut, joint = f"file://{tmp_path}/mod", f"file://{tmp_path}/joint"
    pipeline.land_extracts(spark, [(Extract((path,), "modalidade"), MED1)], cut)
    pipeline.land_extracts(spark, [(Extract((snapshot,), "modalidade", Q[222]), MED1)], joint)
    cuts = {
        frozenset({"modalidade"}): cut,
        frozenset({"registro", "operadora", "modalidade"}): joint,
    }
    inputs = LandedInputs(spark, cuts, "", "")
    assert rows(modality.total_growth(inputs, (MED1,))) == [("MED", 10.0)]
    assert rows(modality.modality_percentage(inputs, (MED1,))) == [("MED", pytest.approx(66.7))]
    table = modality.modality_compare(inputs, (MED1,))
    assert ("Total", 300.0, 330.0) in rows(table, "modalidade", "ant", "atu")
    fact = inputs.enrolment((MED1,), {"registro", "modalidade"}, {Q[222]})
    got = sorted(rows(fact, "registro", "modalidade", "beneficiarios"), key=repr)
    assert got == [("1", "autogestao", None), ("1", "medicina_de_grupo", 200),
                   ("2", "autogestao", 130), ("2", "medicina_de_grupo", None)]
    with pytest.raises(LookupError):
        inputs.enrolment((MED1,), {"regiao"}, {Q[222]})


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("mar/15", "1", "2")], "competencia string, a string, b string")
    b = spark.createDataFrame([("jun/15", "3")], "competencia string, a string")
    assert rows(crosstab.union_extracts([a, b])) == [("mar/15", "1", "2"), ("jun/15", "3", None)]
