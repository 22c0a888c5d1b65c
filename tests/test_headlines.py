"""The strip of headline figures from shared aggregates."""

import pytest
from helpers import MED1, ODO1, SMALL, FrameInputs, lives
from pyspark.sql import functions as F

from marketpulse.plans import kpi
from marketpulse.sources.star import STAR_MED, STAR_ODO, STAR_SPECS, StarInputs


class Apart:
    """Inputs without a cut that has everything."""

    def __init__(self, inputs):
        self._inputs = inputs

    def serves(self, *_):
        return False

    def __getattr__(self, name):
        return getattr(self._inputs, name)


def figures(table):
    return sorted(((r.segmento, r.kpi, r.valor, r.texto) for r in table.collect()), key=repr)


def test_two_scans_of_the_lines(spark):
    plan = kpi.kpi_table(StarInputs(spark, SMALL), STAR_SPECS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_linestatus#") and sum("l_linestatus" in line and "Relation" in line for line in plan.splitlines()) == 2


@pytest.mark.parametrize("specs", [STAR_SPECS, (STAR_MED,), (STAR_ODO,)], ids=["both", "MED", "ODO"])
def test_shared_and_separate_passes_agree(spark, specs):
    star = StarInputs(spark, SMALL)
    assert figures(kpi.kpi_table(star, specs)) == figures(kpi.kpi_table(Apart(star), specs))


def test_by_hand(spark):
    anchor = MED1.anchor_quarters[0]

    def two(segmento, registro, before, now, modality, name=None):
        spec = {"MED": MED1, "ODO": ODO1}[segmento]
        at = [(spec.prior, before), (spec.current, now)]
        return [lives(segmento, q, registro, n, name, modality, "norte") for q, n in at if n is not None]

    fact = [
        *two("MED", "1", 100, 150, "medicina_de_grupo"), lives("MED", anchor, "1", 1, None, "m", "norte"),
        *two("MED", "2", 100, 50, "autogestao"), lives("MED", anchor, "2", 1, None, "m", "norte"),
        *two("MED", "3", None, 40, "autogestao", "renamed"), lives("MED", anchor, "3", 1, "old name", "m", "norte"),
        *two("ODO", "1", 10, 20, "odontologia_de_grupo"), lives("ODO", ODO1.anchor_quarters[0], "1", 1, None, "m", "norte"),
        *two("ODO", "9", 30, None, "autogestao"),
        # Members' own lives are those at the medical list's quarter, in both segments.
        lives("ODO", MED1.current, "1", 25, None, "odontologia_de_grupo", "norte"),
    ]
    inputs = FrameInputs(spark, fact, [("MED", "1"), ("MED", "3"), ("MED", "77"), ("ODO", "9")])
    got = {(s, k): v for s, k, v, _ in figures(kpi.lives_figures(inputs, (MED1, ODO1)))}
    assert got[("MED", "totaltri")] == 20.0  # 240 of 200
    assert got[("MED", "modalidade_tri")] == pytest.approx(62.5)  # 150 of 240
    assert got[("MED", "perc_a")] == pytest.approx(0.75)  # 150 of 200: number 3 has a new name
    assert got[("MED", "var_a")] == 50.0
    assert got[("MED", "total_benef")] == 215.0  # 150 + 40, and 25 dental ones
    assert got[("ODO", "totaltri")] == -50.0
    assert got[("ODO", "total_benef")] is None and got[("ODO", "var_a")] is None  # the only member is not in the panel
    assert figures(kpi.lives_figures(inputs, (MED1, ODO1))) == figures(
        kpi.kpi_table(Apart(inputs), (MED1, ODO1)).filter(F.col("kpi").isin("totaltri", "modalidade_tri", "total_benef", "var_a", "perc_a"))
    )


def test_a_missing_quarter_is_named(spark):
    inputs = FrameInputs(spark, [lives("MED", MED1.current, "1", 5, None, "m", "norte")])
    with pytest.raises(Exception, match="MissingPeriod: MED has no data for its prior quarter"):
        kpi.lives_figures(inputs, (MED1,)).collect()
