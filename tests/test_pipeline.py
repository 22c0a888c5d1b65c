"""Landing, marts and reruns."""

import pathlib

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from marketpulse.plans import pipeline
from marketpulse.plans.catalog import JOBS
from marketpulse.sinks import read_mart
from marketpulse.sources.star import STAR_SPECS, StarInputs

HEADLINES = ["q09_market_yoy", "q20_region_share", "q16_finance_members", "q28_individual_total"]


@pytest.fixture(scope="module")
def star(spark):
    return StarInputs(spark, SMALL)


@pytest.fixture(scope="module")
def root(star, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('landing')}"
    pipeline.land(star, STAR_SPECS, path)
    return path


def as_text(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("name", sorted(JOBS))
def test_landed_inputs_give_the_same_results(spark, star, root, name):
    landed = pipeline.landed(spark, root)
    assert as_text(JOBS[name](landed, STAR_SPECS)) == as_text(JOBS[name](star, STAR_SPECS))


def test_period_and_segment_prune_directories(spark, root):
    landed = pipeline.landed(spark, root)
    plan = JOBS["q11_share_total"](landed, STAR_SPECS)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "beneficiarios" in line and "FileScan" in line)
    assert "competencia" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "segmento" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_rerun_of_one_quarter_leaves_the_others(spark, star, root, tmp_path):
    quarter = STAR_SPECS[0].current
    folder = pathlib.Path(root.removeprefix("file://")) / "enrolment"

    def files():
        return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}

    before, rows = files(), as_text(spark.read.parquet(str(folder)))
    pipeline.land_quarters(star, STAR_SPECS, root, {quarter})
    after = files()
    touched = {p.parent for p in set(before) ^ set(after)}
    assert {p.name for p in touched} == {f"competencia={quarter}"}
    assert all(before[p] == after[p] for p in set(before) & set(after))
    assert as_text(spark.read.parquet(str(folder))) == rows


def test_run_writes_marts_by_segment(spark, star, tmp_path):
    marts = f"file://{tmp_path}/marts"
    pipeline.run(star, STAR_SPECS, marts, HEADLINES)
    for name in HEADLINES:
        mart = read_mart(spark, marts, pipeline.mart_name(name))
        assert as_text(mart) == as_text(JOBS[name](star, STAR_SPECS))
    # One segment's rerun replaces that segment only.
    (med,) = [s for s in STAR_SPECS if s.segmento == "MED"]
    pipeline.run(star, (med,), marts, ["q09_market_yoy"])
    mart = read_mart(spark, marts, "market_yoy")
    assert mart.select(F.countDistinct("segmento")).first()[0] == 2


def test_shared_directory_is_the_sessions_own(spark):
    class Unset:
        class conf:
            get = staticmethod(lambda key, default: default)

    assert pipeline.shared_directory(spark) == spark.conf.get("spark.checkpoint.dir")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        pipeline.shared_directory(Unset)


@pytest.mark.parametrize(
    "name, folder",
    [
        ("q09_market_yoy", "enrolment-by-registro-operadora"),
        ("q02a_period_by_modality", "enrolment-by-modalidade"),
        ("q25_region_yoy", "enrolment-by-regiao"),
        ("q20_region_share", "enrolment-by-registro-regiao"),
        ("q10_share_modality", "enrolment-by-registro-operadora-modalidade"),
    ],
)
def test_each_family_reads_its_own_cut(spark, root, name, folder):
    files = JOBS[name](pipeline.landed(spark, root), STAR_SPECS).inputFiles()
    cuts = {part for f in files for part in f.split("/") if part.startswith("enrolment")}
    assert cuts == {folder}
