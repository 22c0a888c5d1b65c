"""Small hand-worked cases for the rules that are easy to get wrong."""

from dataclasses import replace
from datetime import date

import pytest
from helpers import MED1, ODO1, FrameInputs, Q, lives, rows
from pyspark.sql import functions as F

from marketpulse.functions import numeric, periods
from marketpulse.operators import crosstab
from marketpulse.operators.compare import series, year_over_year
from marketpulse.operators.members import flag_members
from marketpulse.plans import enrolment, finance, individual, kpi, modality, region
from marketpulse.spec import Category


def test_flag_survives_duplicate_and_null_ids(spark):
    inputs = FrameInputs(spark, members=[("MED", "1"), ("MED", "1"), ("MED", "3")])
    ops = spark.createDataFrame(
        [("MED", r) for r in ("1", "2", "3", None)], "segmento string, registro string"
    )
    out = {r: a for _, r, a in rows(flag_members(ops, inputs.members((MED1,))))}
    assert out == {"1": 1, "2": 0, "3": 1, None: 0}
    assert rows(kpi.member_count(inputs, (MED1,))) == [("MED", 3)]


@pytest.mark.parametrize("members, expected", [(["1"], [10, 0]), (["9"], [None, None])])
def test_panel_keeps_anchored_pairs_only(spark, members, expected):
    fact = [
        lives("MED", Q[154], "1", 10, "A"),
        lives("MED", Q[154], "2", 20, "B"),
        lives("MED", Q[161], "1", None, "A"),
        lives("MED", Q[161], "3", 50, "C"),
        lives("MED", Q[161], "2", 25, "B2"),
    ]
    inputs = FrameInputs(spark, fact, [("MED", m) for m in members])
    table = enrolment.market_series(inputs, (MED1,), (Q[154], Q[161])).orderBy("competencia")
    assert rows(table, "competencia", "mercado") == [(Q[154], 30), (Q[161], 0)]
    assert [a for (a,) in rows(table, "associadas")] == expected


def test_panel_is_dense(spark):
    others = [lives("MED", q, "9", 5, "Z") for q in MED1.quarters if q.year > 2015 and q != Q[162]]
    inputs = FrameInputs(spark, [lives("MED", Q[154], "1", 10, "A"), *others])
    panel = enrolment.operator_panel(inputs, (MED1,))
    got = dict(rows(panel, "competencia", "beneficiarios"))
    # Every quarter that anybody has rows in; the first quarters and Q[162] were never published.
    assert set(got) == {q for q in MED1.quarters if q >= Q[154] and q != Q[162]}
    assert {q: n for q, n in got.items() if n} == {Q[154]: 10}


@pytest.mark.parametrize(
    "values, last", [((100, 110, 120, 130, 105), 0.05), ((0, 1, 1, 1, 5), None)]
)
def test_change_over_four_quarters(spark, values, last):
    quarters = (Q[154], Q[161], Q[162], Q[163], Q[164])
    df = spark.createDataFrame(
        [("MED", q, v) for q, v in zip(quarters, values)],
        "segmento string, competencia date, x long",
    )
    got = df.select(
        "competencia", year_over_year("x", series("segmento")).alias("y")
    ).orderBy("competencia")
    changes = [y for _, y in rows(got)]
    assert changes[:4] == [None] * 4
    assert changes[4] == (None if last is None else pytest.approx(last))


def test_missing_count_voids_its_group_and_every_share(spark):
    fact = [
        lives("MED", MED1.current, "1", 5, modalidade="medicina_de_grupo"),
        lives("MED", MED1.current, "2", None, modalidade="medicina_de_grupo"),
        lives("MED", MED1.current, "3", 7, modalidade="medicina_de_grupo"),
        lives("MED", MED1.current, "4", 90, modalidade="autogestao"),
    ]
    inputs = FrameInputs(spark, fact, [("MED", "1"), ("MED", "2")])
    got = {a: (n, p) for _, a, n, p in rows(enrolment.share_of_headline(inputs, (MED1,)))}
    assert got == {1: (None, None), 0: (7, None)}


def _ledger(spec, *positions):
    names = [spec.account(r).conta for r in ("receita", "corresponsabilidade", "outras_deducoes", "despesa")]
    return [
        (spec.segmento, str(i), "m", date(2020, 1, 1), name, value)
        for i, values in enumerate(positions)
        for name, value in zip(names, values)
        if value is not None
    ]


POSITIONS = ((10, None, 0, 4), (10, -1, 0, 4))


def test_missing_account_voids_the_dental_result(spark):
    inputs = FrameInputs(spark, ledger=_ledger(ODO1, *POSITIONS))
    got = finance.operating_result(inputs, (ODO1,)).orderBy("registro")
    assert rows(got, "res_op") == [(None,), (5,)]
    spec = replace(ODO1, money_unit=0.01)
    year = finance.finance_year(FrameInputs(spark, ledger=_ledger(ODO1, *POSITIONS)), (spec,))
    assert rows(year, "ano", "resultado_operacional") == [(2020, 5.0)]


def test_missing_account_is_zero_in_the_medical_result(spark):
    spec = replace(MED1, money_unit=0.01)
    inputs = FrameInputs(spark, ledger=_ledger(MED1, *POSITIONS))
    got = finance.operating_result(inputs, (spec,)).orderBy("registro")
    assert rows(got, "res_op") == [(6,), (5,)]
    assert rows(finance.finance_year(inputs, (spec,)), "resultado_operacional") == [(11.0,)]


def test_member_performance(spark):
    now, before = MED1.current, MED1.prior
    fact = [
        lives("MED", now, "1", 110),
        lives("MED", before, "1", 100),
        lives("ODO", now, "1", 0),
        lives("ODO", before, "1", 0),
        lives("MED", now, "2", 50),
        lives("MED", now, "3", 5),
        lives("MED", before, "3", 0),
        lives("ODO", now, "3", 30),
        lives("ODO", before, "3", 20),
        lives("ODO", now, "4", 99),
        lives("MED", now, "5", 1000),
    ]
    inputs = FrameInputs(spark, fact, [("MED", r) for r in "1234"])
    table = individual.individual_total(inputs, (MED1, ODO1))
    columns = ("registro", "beneficiarios_medicos", "variacao_anual_medico",
               "beneficiarios_odonto", "variacao_anual_odonto")
    assert {r[0]: r[1:] for r in rows(table, *columns)} == {
        "1": (110, "10%", 0, "-"),
        "2": (50, "0%", 0, "-"),
        "3": (5, "0%", 30, "50%"),
        "TOTAL": (165, "", 30, ""),
    }
    assert rows(individual.members_lives(inputs, (MED1, ODO1))) == [("MED", 195.0)]


def test_modality_percentage_is_rounded_before_it_is_scaled(spark):
    fact = [
        lives("MED", MED1.current, "1", 2, modalidade="medicina_de_grupo"),
        lives("MED", MED1.current, "1", 1, modalidade="autogestao"),
    ]
    got = rows(modality.modality_percentage(FrameInputs(spark, fact), (MED1,)))
    assert got == [("MED", pytest.approx(66.7))]


def test_finance_change_uses_rounded_figures(spark):
    conta = MED1.account("receita").conta
    ledger = [
        ("MED", "1", "m", date(y, 1, 1), conta, int(v * 100))
        for y, v in ((2020, 1.234e9), (2021, 1.246e9))
    ]
    inputs = FrameInputs(spark, members=[("MED", "1")], ledger=ledger)
    got = rows(finance.finance_var_ordered(inputs, (MED1,)), "tipo", "ano_ant", "ano_atu", "var")
    assert got[0] == ("Receitas de Contraprestações", 1.23, 1.25, 1.6)
    assert [t for t, *_ in got] == [
        "Receitas de Contraprestações",
        "Despesa Assistencial",
        "Resultado Operacional",
    ]


def test_period_labels(spark):
    df = spark.createDataFrame([(Q[211],), (Q[221],), (date(1998, 10, 1),)], "q date")
    got = rows(df.select(periods.long_label(F.col("q")), periods.label(F.col("q"))))
    assert got == [("Mar 2021", "mar/21"), ("Mar 2022", "mar/22"), ("Dez 1998", "dez/98")]
    labels = spark.createDataFrame([(f"{m}/69",) for m in periods.MONTHS], "t string")
    got = [q for (q,) in rows(labels.select(periods.quarter_of(F.col("t"))))]
    assert got == [date(1969, i // 3 * 3 + 1, 1) for i in range(12)]
    odd = spark.createDataFrame([("mar_15",), ("TOTAL",), ("xyz/15",), (None,)], "t string")
    got = [q for (q,) in rows(odd.select(periods.quarter_of(F.col("t"))))]
    assert got == [date(2015, 1, 1), None, None, None]


CELLS = [("MED", "x", "a", 1), ("MED", "y", "a", 2), ("MED", "y", "b", 5)]


def test_crosstab_margins(spark):
    fact = spark.createDataFrame(
        CELLS, "segmento string, linha string, modalidade string, beneficiarios long"
    )
    table = crosstab.wide(fact, ["linha"], "modalidade", [("a", "a"), ("b", "b")])
    got = {r[0]: r[1:] for r in rows(crosstab.add_margin_row(table, "linha"), "linha", "a", "b", "total")}
    assert got == {"x": (1, None, 1), "y": (2, 5, 7), "TOTAL": (3, 5, 8)}
    long = crosstab.with_margins(fact, "linha", "modalidade")
    assert set(rows(long, "linha", "modalidade", "beneficiarios")) == {
        ("x", "a", 1), ("y", "a", 2), ("y", "b", 5),
        ("x", "total", 1), ("y", "total", 7),
        ("TOTAL", "a", 3), ("TOTAL", "b", 5), ("TOTAL", "total", 8),
    }


def test_region_rates_are_sorted_and_labelled(spark):
    fact = [
        lives("MED", MED1.current, "1", 1234, regiao="sul"),
        lives("MED", MED1.current, "2", 8766, regiao="sul"),
        lives("MED", MED1.current, "2", 50, regiao="norte"),
        lives("MED", MED1.current, "1", 70, regiao="nao_identificado"),
    ]
    inputs = FrameInputs(spark, fact, [("MED", "1")])
    got = rows(region.region_share(inputs, (MED1,)), "code_region", "regiao", "taxa", "rotulo")
    assert got[0] == (4, "Sul", 0.1234, "12.3%")
    assert {r[0]: r[2:] for r in got[1:]} == {c: (None, None) for c in (1, 2, 3, 5)}


def test_missing_member_count_voids_its_region(spark):
    fact = [
        lives("MED", MED1.current, "1", None, regiao="sul"),
        lives("MED", MED1.current, "2", 5, regiao="sul"),
        lives("MED", MED1.current, "2", 5, regiao="norte"),
    ]
    inputs = FrameInputs(spark, fact, [("MED", "1"), ("MED", "2")])
    got = dict(rows(region.member_region(inputs, (MED1,)), "regiao", "benef_associadas"))
    assert got["sul"] is None and got["norte"] == 5


@pytest.mark.parametrize(
    "x, digits, expected",
    [(0.15, 1, 0.2), (2.5, 0, 3.0), (-0.25, 1, -0.2), (12.345, 2, 12.35), (None, 1, None)],
)
def test_rounding(spark, x, digits, expected):
    df = spark.createDataFrame([(x,)], "x double")
    assert rows(df.select(numeric.round_to(F.col("x"), digits))) == [(expected,)]


@pytest.mark.parametrize("x, expected", [(12.0, "12"), (12.5, "12.5"), (-0.4, "-0.4"), (0.0, "0")])
def test_number_texts(spark, x, expected):
    df = spark.createDataFrame([(x,)], "x double")
    assert rows(df.select(numeric.number_text(F.col("x")))) == [(expected,)]


def test_segments_may_compare_different_quarters(spark):
    fact = [
        lives("MED", MED1.prior, "1", 100, modalidade="x"),
        lives("MED", MED1.current, "1", 150, modalidade="x"),
        lives("ODO", ODO1.prior, "1", 10, modalidade="x"),
        lives("ODO", ODO1.current, "1", 5, modalidade="x"),
        lives("ODO", MED1.current, "1", 900, modalidade="x"),
    ]
    inputs = FrameInputs(spark, fact)
    assert MED1.current != ODO1.current
    assert dict(rows(modality.total_growth(inputs, (MED1, ODO1)))) == {"MED": 50.0, "ODO": -50.0}
    labels = modality.period_labels(inputs, (MED1, ODO1))
    assert rows(labels, "segmento", "rotulo") == [
        ("MED", "Jun 2021"), ("MED", "Jun 2022"), ("ODO", "Mar 2021"), ("ODO", "Mar 2022"),
    ]


def test_published_axis_orders(spark):
    at = (MED1.prior, MED1.current, ODO1.prior, ODO1.current)
    fact = [
        lives(s.segmento, q, "1", 1, modalidade=m.key, regiao=r.key)
        for s in (MED1, ODO1) for q in at for m in s.modalities for r in s.regions
    ]
    inputs, specs = FrameInputs(spark, fact), (MED1, ODO1)
    by = {}
    for s, label in rows(modality.modality_compare(inputs, specs), "segmento", "modalidade"):
        by.setdefault(s, []).append(label)
    assert by["MED"] == ["Filantropia", "Autogestão", "Seguradoras", "Cooperativa Médica",
                         "Medicina de Grupo", "Total"]
    assert by["ODO"] == ["Autogestão", "Filantropia", "Cooperativa Médica", "Seguradoras",
                         "Cooperativa Odontológica", "Medicina de Grupo", "Odontologia de Grupo",
                         "Total"]
    by = {}
    for s, label in rows(region.region_compare(inputs, specs), "segmento", "regioes"):
        by.setdefault(s, []).append(label)
    assert by["MED"] == ["Norte", "Centro-Oeste", "Nordeste", "Sul", "Sudeste"]
    assert by["ODO"] == ["Norte", "Centro-Oeste", "Sul", "Nordeste", "Sudeste"]


@pytest.mark.parametrize(
    "changed",
    [
        {"current": date(2022, 5, 1)},
        {"prior": date(2021, 1, 1)},
        {"last_quarter": date(2021, 10, 1)},
        {"fin_years": (2021, 2020)},
    ],
)
def test_spec_rejects_impossible_periods(changed):
    with pytest.raises(ValueError):
        replace(MED1, **changed)


def test_category_columns():
    assert Category("MIDDLE EAST", "Middle East", 1).column == "middle_east"
