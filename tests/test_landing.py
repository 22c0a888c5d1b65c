"""From files to marts: nothing is lost, chosen or rounded silently."""

import pathlib
from dataclasses import replace
from datetime import date

import pytest
from helpers import MED1, ODO1, SMALL, FrameInputs, Q, lives, rows
from pyspark.sql import functions as F

from marketpulse.functions.numeric import sum_with_holes, whole_number
from marketpulse.functions.periods import quarter_of_label
from marketpulse.operators import crosstab
from marketpulse.plans import enrolment, modality, pipeline
from marketpulse.plans.catalog import JOBS, NEEDS, lacks
from marketpulse.sinks import partitions, write_mart, write_partitions
from marketpulse.sources.extracts import Extract, headers, read_extract, read_text_crosstab
from marketpulse.sources.files import LedgerFiles, MemberFiles
from marketpulse.sources.inputs import Cut, LandedInputs, MissingPeriod
from marketpulse.sources.star import STAR_MED, STAR_ODO, STAR_SPECS, StarInputs

OPERATOR = frozenset({"registro", "operadora"})


def _csv(folder, name, *lines):
    path = folder / name
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return f"file://{path}"


def test_requests_of_one_quarter_are_united(spark, tmp_path):
    one = _csv(tmp_path, "1.csv", "registro,operadora,mar_21,mar_22,total", "1,A,10,11,21", "TOTAL,TOTAL,10,11,21")
    two = _csv(tmp_path, "2.csv", "registro,operadora,mar_21,mar_22,total", "2,B,20,22,42")
    requests = [(Extract((p,), "competencia"), MED1) for p in (one, two)]
    (cut,) = pipeline.land_extracts(spark, requests, f"file://{tmp_path}/cut")
    inputs = LandedInputs(spark, [cut], "", "")
    fact = inputs.enrolment((MED1,), OPERATOR, [Q[211], Q[221]])
    assert sorted(rows(fact, "competencia", "registro", "beneficiarios")) == [
        (Q[211], "1", 10), (Q[211], "2", 20), (Q[221], "1", 11), (Q[221], "2", 22),
    ]


def test_a_cell_given_twice_is_an_error(spark, tmp_path):
    one = _csv(tmp_path, "1.csv", "registro,operadora,mar_21", "1,A,10")
    two = _csv(tmp_path, "2.csv", "registro,operadora,mar_21,jun_21", "1,A,10,12")
    requests = [(Extract((p,), "competencia"), MED1) for p in (one, two)]
    with pytest.raises(Exception, match="a cell is given twice: .*2021-01-01"):
        pipeline.land_extracts(spark, requests, f"file://{tmp_path}/cut")


def test_published_totals_are_a_cut_of_their_own(spark, tmp_path):
    """A missing cell voids the cells' sums, not the published total."""
    path = _csv(tmp_path, "s.csv", "registro,operadora,autogestao,odontologia_de_grupo,total",
                "1,A,-,200,200", "2,B,300,-,300", "3,C,-,-,100", "TOTAL,TOTAL,300,200,600")
    snapshot = [(Extract((path,), "modalidade", ODO1.current), ODO1)]
    cuts = pipeline.land_extracts(spark, snapshot, f"file://{tmp_path}/cells", f"file://{tmp_path}/totals")
    assert [c.dims for c in cuts] == [OPERATOR | {"modalidade"}, OPERATOR]
    members = f"file://{tmp_path}/members"
    write_partitions(spark.createDataFrame([("ODO", "1", 1)], "segmento string, registro string, associada int"),
                     members, ["segmento"])
    inputs = LandedInputs(spark, cuts, members, "")
    share = enrolment.share_of_total(inputs, (ODO1,))
    got = {a: (n, p) for a, n, p in rows(share, "associada", "beneficiarios", "percentual")}
    assert got == {1: (200, pytest.approx(1 / 3)), 0: (400, pytest.approx(2 / 3))}
    labels = enrolment.share_labels(inputs, (ODO1,))
    assert sorted(rows(labels, "associada", "beneficiarios")) == [("Associadas", 200), ("Não associadas", 400)]
    without = enrolment.share_of_total(LandedInputs(spark, cuts[:1], members, ""), (ODO1,))
    assert {p for (p,) in rows(without, "percentual")} == {None}


def _land(spark, path, rows_, schema="segmento string, competencia date, modalidade string, beneficiarios long"):
    write_partitions(spark.createDataFrame(rows_, schema), path, ["segmento", "competencia"])
    return path


def test_a_cut_without_the_prior_quarter_is_not_chosen(spark, tmp_path):
    now, before = MED1.current, MED1.prior
    small = _land(spark, f"file://{tmp_path}/small", [("MED", now, "m", 120)])
    large = _land(
        spark, f"file://{tmp_path}/large",
        [("MED", now, "m", "r", 120), ("MED", before, "m", "r", 100)],
        "segmento string, competencia date, modalidade string, regiao string, beneficiarios long",
    )
    cuts = [Cut(frozenset({"modalidade"}), small), Cut(frozenset({"modalidade", "regiao"}), large)]
    growth = modality.total_growth(LandedInputs(spark, cuts, "", ""), (MED1,))
    assert rows(growth) == [("MED", 20.0)]
    with pytest.raises(MissingPeriod, match="prior quarter"):
        modality.total_growth(LandedInputs(spark, cuts[:1], "", ""), (MED1,))
    other = _land(spark, f"file://{tmp_path}/other", [("MED", before, "m", 100)])
    apart = [cuts[0], Cut(frozenset({"modalidade"}), other)]
    with pytest.raises(LookupError, match="no single cut"):
        modality.total_growth(LandedInputs(spark, apart, "", ""), (MED1,))


def test_partitions_that_came_out_empty_go(spark, tmp_path):
    root = f"file://{tmp_path}"
    table = spark.createDataFrame([("MED", 1), ("ODO", 2)], "segmento string, x int")
    write_mart(table, root, "m", ["MED", "ODO"])
    write_mart(table.filter("segmento = 'MED'"), root, "m", ["MED", "ODO"])
    assert rows(spark.read.parquet(f"{root}/m"), "segmento", "x") == [("MED", 1)]
    # a segment that was not asked for stays
    write_mart(table, root, "m", ["MED", "ODO"])
    write_mart(table.filter("segmento = 'MED'"), root, "m", ["MED"])
    assert sorted(rows(spark.read.parquet(f"{root}/m"), "segmento")) == [("MED",), ("ODO",)]


def test_a_quarter_and_a_ledger_year_without_rows_go(spark, tmp_path):
    q = [Q[161], Q[162]]
    both = [lives(s, at, "1", 5, "A", "m", "r") for s in ("MED", "ODO") for at in q]
    ledger = [("MED", "1", "m", date(y, 1, 1), "despesa_administrativa", 5) for y in (2020, 2021)]
    root, specs = f"file://{tmp_path}", (MED1, ODO1)
    full = FrameInputs(spark, both, [("MED", "1")], ledger)
    pipeline.land_quarters(full, specs, root, q)
    pipeline.land_ledger(full, specs, root)
    less = FrameInputs(spark, [r for r in both if r[:2] != ("ODO", q[1])], [], ledger[:1])
    pipeline.land_quarters(less, specs, root, q[1:])
    held = {(p["segmento"], p["competencia"]) for p in partitions(spark, f"{root}/enrolment")}
    assert held == {("MED", "2016-01-01"), ("MED", "2016-04-01"), ("ODO", "2016-01-01")}
    pipeline.land_ledger(less, specs, root, years=[2020])
    assert {p["ano"] for p in partitions(spark, f"{root}/ledger")} == {"2020", "2021"}
    pipeline.land_ledger(less, specs, root)
    assert {p["ano"] for p in partitions(spark, f"{root}/ledger")} == {"2020"}


def test_only_months_that_close_a_quarter(spark, tmp_path):
    wide = _csv(tmp_path, "w.csv", "registro,operadora,jan_22,fev_22,mar_22", "1,A,10,11,12")
    got = read_extract(spark, Extract((wide,), "competencia"), MED1)
    assert rows(got, "competencia", "beneficiarios") == [(Q[221], 12)]
    tall = _csv(tmp_path, "t.csv", "competencia,autogestao,total", "jan/22,10,10", "mar/22,12,12", "TOTAL,22,22")
    got = read_extract(spark, Extract((tall,), "modalidade"), MED1)
    assert rows(got, "competencia", "beneficiarios") == [(Q[221], 12)]
    monthly = Extract((wide,), "competencia", months=(1, 2, 3))
    assert read_extract(spark, monthly, MED1).count() == 3
    assert quarter_of_label("jun_15") == date(2015, 4, 1) and quarter_of_label("DEZ/98") == date(1998, 10, 1)
    assert quarter_of_label("jan_15") is None and quarter_of_label("total") is None


@pytest.mark.parametrize(
    "text, plain, marked",
    [("12", 12, 12), (" 7 ", 7, 7), ("-", None, None), ("1.234", None, 1234), ("1.234,5", None, None),
     ("12.0", 12, None), ("1.23", None, None), ("1.234.567", None, 1234567), ("", None, None), (None, None, None),
     ("-5", -5, -5), ("99999999999999999999", None, None)],
)
def test_cells_that_are_no_whole_number_are_missing(spark, text, plain, marked):
    df = spark.createDataFrame([(text,)], "x string")
    assert rows(df.select(whole_number(F.col("x")), whole_number(F.col("x"), "."))) == [(plain, marked)]


def test_operator_extract_is_compiled(spark, tmp_path):
    path = _csv(tmp_path, "c.csv", "registro,operadora,mar_21,jun_21,total", "1,A,1,2,3", "2,B,-,4,4")
    before = spark.conf.get("spark.sql.codegen.fallback", None)
    try:
        spark.conf.set("spark.sql.codegen.fallback", "false")
        assert read_extract(spark, Extract((path,), "competencia"), MED1).count() == 4
    finally:
        spark.conf.unset("spark.sql.codegen.fallback") if before is None else spark.conf.set("spark.sql.codegen.fallback", before)


def test_files_are_grouped_by_header(spark, tmp_path):
    paths = [_csv(tmp_path, f"{k}.csv", "registro,operadora,mar_21", f"{k},O{k},{k}") for k in range(6)]
    paths.append(_csv(tmp_path, "x.csv", "registro,operadora,jun_21", "9,X,9"))
    assert len(set(headers(spark, paths).values())) == 2
    tables = read_text_crosstab(spark, paths)
    assert sorted(t.count() for t in tables) == [1, 6]
    with pytest.raises(ValueError, match="no header"):
        headers(spark, [paths[0], f"file://{_empty(tmp_path)}"])


def _empty(folder):
    path = folder / "empty.csv"
    path.write_text("")
    return path


def test_files_to_marts(spark, tmp_path):
    med, odo = replace(MED1, current=Q[222], prior=Q[212]), ODO1
    tall = _csv(tmp_path, "mod.csv", "competencia,autogestao,medicina_de_grupo,total", "jun/21,100,200,300", "jun/22,110,220,330")
    snapshot = _csv(tmp_path, "op.csv", "registro,operadora,autogestao,medicina_de_grupo,total",
                    "1,A,-,200,200", "2,B,130,-,130", "TOTAL,TOTAL,130,200,330")
    members = _csv(tmp_path, "m.csv", "Cód. ANS;Razão Social", "1;A", "7;G")
    income, expense = med.accounts[0].conta, med.accounts[4].conta
    long = _csv(tmp_path, "l.csv", "Registro,Modalidade,Ano,Class Conta,Saldo Final",
                f"1,Medicina de Grupo,2021,{income},100.50", f"1,Medicina de Grupo,2021,{expense},40")
    wide = f"file://{tmp_path}/wide.parquet"
    spark.createDataFrame([("5", "2021 Q2", 10.0, -1.0, 0.0, 4.0), ("6", "2021 Q2", 10.0, None, 0.0, 4.0)],
                          "registro string, ano_tri string, " + ", ".join(f"{a.conta} double" for a in odo.accounts)
                          ).write.parquet(wide)
    inputs = pipeline.land_files(
        spark, f"file://{tmp_path}/landed",
        {"modality": [(Extract((tall,), "modalidade"), med)],
         "snapshot": [(Extract((snapshot,), "modalidade", Q[222]), med)]},
        [MemberFiles((members,), med, ";")],
        [LedgerFiles((long,), "long", (med,)), LedgerFiles((wide,), "wide", (odo,))],
    )
    assert rows(modality.total_growth(inputs, (med,))) == [("MED", 10.0)]
    share = enrolment.share_of_total(inputs, (med,))
    assert sorted(rows(share, "associada", "beneficiarios")) == [(0, 130), (1, 200)]
    result = JOBS["q12_result_med"](inputs, (med,))
    assert rows(result, "registro", "ano", "res_op") == [("1", 2021, 6050)]
    result = JOBS["q13_result_odo"](inputs, (odo,))
    assert sorted(rows(result, "registro", "res_op")) == [("5", 500), ("6", None)]
    assert rows(JOBS["q39_member_count"](inputs, (med,))) == [("MED", 2)]
    with pytest.raises(ValueError, match="layout"):
        LedgerFiles((long,), "other", (med,)).read(spark)


@pytest.mark.parametrize("spec", [STAR_MED, STAR_ODO], ids=["MED", "ODO"])
def test_one_segment_alone(spark, spec):
    star = StarInputs(spark, SMALL)
    marts = pipeline.build_marts(star, (spec,))
    assert {n for n in JOBS if lacks(n, (spec,))} == set(JOBS) - set(marts)
    for name, table in marts.items():
        assert "segmento" not in table.columns or {r.segmento for r in table.collect()} <= {spec.segmento}, name
    missing = next(n for n in NEEDS if lacks(n, (spec,)))
    with pytest.raises(ValueError, match="needs the segments"):
        pipeline.build_marts(star, (spec,), [missing])


def test_rows_of_the_series_are_in_time_order(spark):
    for name in ("q09_market_yoy", "q25_region_yoy"):
        got = rows(JOBS[name](StarInputs(spark, SMALL), STAR_SPECS), "segmento", "trimestre")
        assert got == sorted(got) and len(got) > 10


def test_sums_with_holes_keep_them(spark):
    table = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3), ("c", None)], "k string, x long")
    got = sorted(rows(sum_with_holes(table, ["k"], "x"), "k", "x"), key=repr)
    assert got == sorted([("a", 1), ("a", None), ("b", 5), ("c", None)], key=repr)


def test_unite_keeps_missing_cells(spark):
    a = spark.createDataFrame([("1", None)], "registro string, beneficiarios long")
    b = spark.createDataFrame([("2", 4)], "registro string, beneficiarios long")
    assert sorted(rows(crosstab.unite([a, b]))) == [("1", None), ("2", 4)]


def test_a_run_leaves_no_copy_of_its_inputs(spark, tmp_path):
    shared = pathlib.Path(pipeline.shared_directory(spark).removeprefix("file://"))
    for _ in range(2):
        pipeline.run(StarInputs(spark, SMALL), STAR_SPECS, f"file://{tmp_path}/marts", ["q21_total_growth"])
        assert not list(shared.glob("inputs-*"))
