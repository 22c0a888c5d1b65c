"""Quarters that are not there: no zero lives, no change against them, a named error where they are needed."""

from datetime import date

import pytest
from helpers import MED1, ODO1, SMALL, FrameInputs, Q, lives, rows
from pyspark.sql import functions as F

from marketpulse.plans import enrolment, modality, pipeline, region
from marketpulse.sinks import remove
from marketpulse.sources.inputs import MissingPeriod, Replaced, Selected
from marketpulse.sources.star import STAR_MED, STAR_SPECS, StarInputs

GAP = date(1998, 1, 1)


@pytest.fixture(scope="module")
def star(spark):
    return StarInputs(spark, SMALL)


@pytest.fixture(scope="module")
def with_gap(spark, star, tmp_path_factory):
    """Landed tables from which one quarter of one segment was never fetched."""
    root = f"file://{tmp_path_factory.mktemp('gap')}"
    pipeline.land(star, STAR_SPECS, root)
    for cut in ("enrolment", "enrolment-by-registro-operadora", "enrolment-by-registro-operadora-modalidade"):
        remove(spark, f"{root}/{cut}/segmento=MED/competencia={GAP}")
    return pipeline.landed(spark, root)


def series(table):
    return {(r.segmento, r.trimestre): r for r in table.collect()}


def test_a_quarter_that_was_not_landed(spark, star, with_gap):
    whole, got = (series(enrolment.market_yoy(i, STAR_SPECS)) for i in (star, with_gap))
    assert set(whole) - set(got) == {("MED", GAP)}
    after = ("MED", date(1999, 1, 1))
    assert got[after].var_tri_mercado is None and got[after].var_tri_assoc is None
    assert got[after].mercado == whole[after].mercado
    assert all(got[k] == whole[k] for k in got if k != after)
    panel = enrolment.operator_panel(with_gap, STAR_SPECS)
    assert panel.filter((F.col("segmento") == "MED") & (F.col("competencia") == GAP)).count() == 0
    assert panel.filter((F.col("segmento") == "ODO") & (F.col("competencia") == GAP)).count() > 0
    totals = {k: r.beneficiarios for k, r in series(enrolment.market_total(with_gap, STAR_SPECS)).items()}
    assert ("MED", GAP) not in totals and all(totals.values())


def test_the_same_without_landing(star, with_gap):
    quarters = [*STAR_MED.quarters]
    got = series(enrolment.market_yoy(Selected(star, set(quarters) - {GAP}), (STAR_MED,)))
    landed = series(enrolment.market_yoy(with_gap, (STAR_MED,)))
    assert got == landed


def test_an_anchor_year_without_data(spark, star, tmp_path):
    root = f"file://{tmp_path}"
    pipeline.land_quarters(star, STAR_SPECS, root, [STAR_MED.prior, STAR_MED.current])
    pipeline.land_members(star, STAR_SPECS, root)
    with pytest.raises(MissingPeriod, match="MED has no data in its anchor year 1995"):
        enrolment.market_yoy(pipeline.landed(spark, root), STAR_SPECS)
    with pytest.raises(MissingPeriod, match="anchor year"):
        enrolment.market_total(Selected(star, [STAR_MED.current, STAR_MED.prior]), STAR_SPECS)
    frame = FrameInputs(spark, [lives("MED", Q[161], "1", 5, "A", "m", "r")])
    for inputs in (frame, Replaced(frame, enrolment={frozenset({"registro", "operadora"}): frame.enrolment((MED1,), {"registro", "operadora"}, [Q[161]])})):
        with pytest.raises(Exception, match="MissingPeriod: MED has no data in its anchor year 2015"):
            enrolment.operator_panel(inputs, (MED1,)).collect()


def test_part_of_an_anchor_year_is_enough(spark):
    inputs = FrameInputs(spark, [lives("MED", Q[154], "1", 5), lives("MED", Q[161], "1", 6), lives("MED", Q[161], "2", 7)])
    assert sorted(rows(enrolment.market_total(inputs, (MED1,)), "trimestre", "beneficiarios")) == [(Q[154], 5), (Q[161], 6)]


@pytest.mark.parametrize("job", [modality.total_growth, modality.snapshot_indicators, modality.modality_compare, region.region_compare])
def test_a_compared_quarter_without_rows(spark, job):
    """Any kind of inputs, without another pass: the aggregate itself sees that it has no rows."""
    now, before = (lives("MED", q, "1", 5, "A", "autogestao", "norte") for q in (MED1.current, MED1.prior))
    assert job(FrameInputs(spark, [now, before]), (MED1,)).count() > 0
    with pytest.raises(Exception, match=f"MissingPeriod: MED has no data for its prior quarter {MED1.prior}"):
        job(FrameInputs(spark, [now]), (MED1,)).collect()
    both = FrameInputs(spark, [now, before, lives("ODO", ODO1.prior, "1", 5, "A", "autogestao", "norte")])
    with pytest.raises(Exception, match="MissingPeriod: ODO has no data for its current quarter"):
        job(both, (MED1, ODO1)).collect()


def test_a_quarter_is_observed_as_it_is_landed(spark, tmp_path):
    now = FrameInputs(spark, [lives("MED", MED1.current, "1", 5, "A", "m", "r")])
    with pytest.raises(MissingPeriod, match="prior quarter"):
        pipeline.land_quarters(now, (MED1,), f"file://{tmp_path}/a", [MED1.prior, MED1.current])
    pipeline.land_quarters(now, (MED1,), f"file://{tmp_path}/b", [MED1.current])
