"""Relations that must hold between results, on the given tables."""

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from marketpulse.operators import crosstab
from marketpulse.plans import crosstabs, enrolment, region
from marketpulse.plans.catalog import JOBS
from marketpulse.sources.star import STAR_SPECS, StarInputs
from marketpulse.spec import all_quarters


@pytest.fixture(scope="module")
def inputs(spark):
    return StarInputs(spark, SMALL)


def test_regions_and_unidentified_add_up_to_the_total(inputs):
    table = crosstabs.period_by_region(inputs, STAR_SPECS)
    names = [n for _, n in crosstabs.region_columns(STAR_SPECS)] + ["nao_identificado"]
    parts = sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0))
    assert table.filter(parts != F.col("total")).count() == 0


@pytest.mark.parametrize("query", ["q10_share_modality", "q10o_share_modality", "q11_share_total"])
def test_shares_add_up_to_one(inputs, query):
    sums = JOBS[query](inputs, STAR_SPECS).groupBy("segmento").agg(F.sum("percentual").alias("s"))
    assert [s for _, s in sums.collect()] == [pytest.approx(1.0)]


def test_margins_equal_direct_sums(inputs):
    margins = crosstabs.margins(inputs, STAR_SPECS)
    fact = inputs.enrolment(STAR_SPECS, {"modalidade"}, all_quarters(STAR_SPECS))
    for keys, where in (
        (["segmento", "competencia"], "competencia <> 'TOTAL' AND modalidade = 'total'"),
        (["segmento", "modalidade"], "competencia = 'TOTAL' AND modalidade <> 'total'"),
        (["segmento"], "competencia = 'TOTAL' AND modalidade = 'total'"),
    ):
        direct = fact.groupBy(*keys).agg(F.sum("beneficiarios").alias("beneficiarios"))
        direct = direct.select(*[F.col(c).cast("string") for c in direct.columns])
        stated = margins.filter(where).select(*keys, F.col("beneficiarios").cast("string"))
        assert sorted(direct.collect()) == sorted(stated.collect())


def test_unpivot_undoes_pivot(inputs):
    fact = inputs.enrolment(STAR_SPECS, {"registro", "operadora"}, all_quarters(STAR_SPECS))
    table = crosstabs.operator_by_period(inputs, STAR_SPECS)
    texts = table.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in table.columns]
    )
    back = crosstab.to_fact(texts, "competencia", keep_missing=False)
    keys = ["segmento", "registro", "operadora", "competencia"]
    direct = fact.groupBy(*keys).agg(F.sum("beneficiarios").alias("beneficiarios"))
    assert sorted(back.select(*direct.columns).collect()) == sorted(direct.collect())


def test_change_is_null_for_the_first_four_quarters_only(inputs):
    table = enrolment.with_yearly_change(enrolment.market_series(inputs, STAR_SPECS))
    for _, group in _by_segment(table):
        group.sort(key=lambda r: r.competencia)
        assert [r.var_tri_mercado is None for r in group] == [i < 4 for i in range(len(group))]


def _by_segment(table):
    out = {}
    for r in table.collect():
        out.setdefault(r.segmento, []).append(r)
    return out.items()


def test_members_never_exceed_the_market(inputs):
    series = enrolment.market_series(inputs, STAR_SPECS)
    assert series.filter("associadas > mercado").count() == 0
    rates = region.region_share(inputs, STAR_SPECS)
    assert rates.filter("taxa > 1 OR taxa < 0").count() == 0


def test_panel_covers_anchored_operators_only(inputs):
    panel = enrolment.operator_panel(inputs, STAR_SPECS)
    silent = panel.groupBy("segmento", "registro").agg(
        F.sum(F.when(F.year("competencia") == 1995, F.col("beneficiarios"))).alias("n")
    )
    assert silent.filter("n IS NULL OR n = 0").count() == 0
    counts = panel.groupBy("segmento", "registro", "operadora").count().select("count").distinct()
    assert [c for (c,) in counts.collect()] == [len(all_quarters(STAR_SPECS))]


def test_one_segment_alone_gives_that_segments_rows(inputs):
    for job in (enrolment.market_yoy, region.region_compare, JOBS["q14_finance_year"]):
        both = job(inputs, STAR_SPECS)
        for spec in STAR_SPECS:
            alone = job(inputs, (spec,))
            assert sorted(alone.collect()) == sorted(
                both.filter(F.col("segmento") == spec.segmento).select(*alone.columns).collect()
            )


def test_kpi_strip_equals_the_single_results(inputs):
    kpis = {(r.segmento, r.kpi): (r.valor, r.texto) for r in JOBS["q42_kpi_table"](inputs, STAR_SPECS).collect()}
    for query in ("q21_total_growth", "q22_modality_pct", "q23_finance_cells", "q38_finance_growth",
                  "q34_finance_var_cells", "q31_member_growth", "q29_members_lives_med",
                  "q30_members_lives_odo", "q32_member_coverage", "q39_member_count"):
        for row in JOBS[query](inputs, STAR_SPECS).collect():
            cells = row.asDict()
            segmento = cells.pop("segmento")
            cells.pop("texto", None)
            for name, value in cells.items():
                assert kpis[(segmento, name)][0] == value, (query, name)
    assert kpis[("MED", "n_associadas")][1] == str(int(kpis[("MED", "n_associadas")][0]))
    assert kpis[("MED", "total_benef")][1].endswith(" milhões")
    assert kpis[("ODO", "fat_total")][1].endswith(" bi")
