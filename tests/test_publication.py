"""Marts that readers see whole, and rebuilds that touch only what a quarter reaches."""

import json
import pathlib
from datetime import date

import pytest
from helpers import MED1, SMALL, FrameInputs, rows
from pyspark.sql import functions as F

from marketpulse import sinks
from marketpulse.plans import pipeline
from marketpulse.plans.catalog import JOBS, SERIES, reached
from marketpulse.sources.extracts import headers
from marketpulse.sources.star import STAR_MED, STAR_SPECS, StarInputs

SCHEMA = "segmento string, trimestre date, x int"
A, B = date(2021, 1, 1), date(2021, 4, 1)
BY = ["segmento", "trimestre"]


def table(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def folder(root):
    return pathlib.Path(root.removeprefix("file://"))


def as_text(df):
    return sorted(repr(sorted(r.asDict().items())) for r in df.collect())


def test_a_write_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    sinks.publish(table(spark, ("MED", A, 1), ("ODO", A, 2)), root, "m", BY)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(sinks, "_commit", dies)  # the new files are there, the manifest is not
        with pytest.raises(KeyboardInterrupt):
            sinks.publish(table(spark, ("MED", A, 7)), root, "m", BY, lambda p: p["segmento"] == "MED")
    assert sorted(rows(sinks.read_mart(spark, root, "m"))) == [("MED", A, 1), ("ODO", A, 2)]
    assert len(list((tmp_path / "m" / "writes").iterdir())) == 2
    sinks.vacuum(spark, root, "m")
    assert len(list((tmp_path / "m" / "writes").iterdir())) == 1
    sinks.publish(table(spark, ("MED", A, 7)), root, "m", BY, lambda p: p["segmento"] == "MED")
    assert sorted(rows(sinks.read_mart(spark, root, "m"))) == [("MED", A, 7), ("ODO", A, 2)]


def test_a_write_that_dies_within_the_manifest(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}"
    sinks.publish(table(spark, ("MED", A, 1)), root, "m", BY)
    real = sinks._write_text

    def half(spark_, path, text):
        real(spark_, path, text[:20])
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(sinks, "_write_text", half)
        with pytest.raises(KeyboardInterrupt):
            sinks.publish(table(spark, ("MED", A, 7)), root, "m", BY)
    assert rows(sinks.read_mart(spark, root, "m")) == [("MED", A, 1)]


def test_a_reader_keeps_what_it_has_read(spark, tmp_path):
    """A plan made before a publication still finds its files after it."""
    root = f"file://{tmp_path}"
    sinks.publish(table(spark, ("MED", A, 1)), root, "m", BY)
    reader = sinks.read_mart(spark, root, "m")
    sinks.publish(table(spark, ("MED", A, 2)), root, "m", BY)
    assert rows(reader) == [("MED", A, 1)] and rows(sinks.read_mart(spark, root, "m")) == [("MED", A, 2)]
    for x in (3, 4, 5):
        sinks.publish(table(spark, ("MED", A, x)), root, "m", BY)
    assert len(list((tmp_path / "m" / "writes").iterdir())) == 2
    assert len(list((tmp_path / "m" / "manifests").glob("manifest-*.json"))) == 2


def test_two_writers_from_one_manifest(spark, tmp_path):
    root = f"file://{tmp_path}"
    sinks.publish(table(spark, ("MED", A, 1)), root, "m", BY)
    manifest = sinks._manifest(spark, f"{root}/m", 1)
    sinks._commit(spark, f"{root}/m", 2, manifest)
    with pytest.raises(RuntimeError, match="another writer"):
        sinks._commit(spark, f"{root}/m", 2, manifest)
    names = {p.name.removesuffix(".crc").lstrip(".") for p in (tmp_path / "m" / "manifests").iterdir()}
    assert names == {"manifest-0000000001.json", "manifest-0000000002.json"}


def test_partitions_without_rows_go_and_types_stay(spark, tmp_path):
    root = f"file://{tmp_path}"
    sinks.publish(table(spark, ("MED", A, 1), ("MED", B, 2), ("ODO", B, 3)), root, "m", BY)
    sinks.publish(table(spark, ("MED", A, 4)), root, "m", BY, lambda p: p["segmento"] == "MED")
    got = sinks.read_mart(spark, root, "m")
    assert sorted(rows(got)) == [("MED", A, 4), ("ODO", B, 3)] and got.schema == table(spark).schema
    sinks.publish(table(spark), root, "m", BY)
    got = sinks.read_mart(spark, root, "m")
    assert rows(got) == [] and got.schema == table(spark).schema
    sinks.publish(spark.range(3).toDF("y"), root, "n")
    assert sorted(rows(sinks.read_mart(spark, root, "n"))) == [(0,), (1,), (2,)]
    with pytest.raises(FileNotFoundError):
        sinks.read_mart(spark, root, "other")
    # a mart that was partitioned otherwise is replaced as a whole
    sinks.publish(table(spark, ("MED", B, 9)), root, "n", BY, lambda p: False)
    assert rows(sinks.read_mart(spark, root, "n")) == [("MED", B, 9)]


class Changed:
    """The star's inputs, in which one quarter's lives were corrected."""

    def __init__(self, star, quarter):
        self._star, self._quarter, self.spark = star, quarter, star.spark

    def __getattr__(self, name):
        return getattr(self._star, name)

    def enrolment(self, specs, dims, quarters):
        fact = self._star.enrolment(specs, dims, quarters)
        more = F.when(F.col("competencia") == self._quarter, 3).otherwise(1)
        return fact.withColumn("beneficiarios", F.col("beneficiarios") * more)


NAMES = ["q02a_period_by_modality", "q06_anchor_panel", "q09_market_yoy", "q25_region_yoy"]
NAMES += ["q20_region_share", "q42_kpi_table", "q14_finance_year"]


@pytest.mark.parametrize("quarter", [date(1998, 4, 1), STAR_MED.prior], ids=["inner", "compared"])
def test_a_changed_quarter_rewrites_what_it_reaches(spark, tmp_path, quarter):
    star = StarInputs(spark, SMALL)
    landing, marts = (f"file://{tmp_path}/{n}" for n in ("landing", "marts"))
    pipeline.run(star, STAR_SPECS, marts, NAMES, landing)
    before = {n: json.loads((folder(marts) / pipeline.mart_name(n) / "manifests" / "manifest-0000000001.json").read_text()) for n in NAMES}
    written = pipeline.refresh(Changed(star, quarter), STAR_SPECS, landing, marts, [quarter], NAMES)
    for name in NAMES:
        mart = pipeline.mart_name(name)
        whole = JOBS[name](Changed(star, quarter), STAR_SPECS)
        assert as_text(sinks.read_mart(spark, marts, mart)) == as_text(whole), name
        numbers = sinks._manifests(spark, f"{marts}/{mart}")
        after = sinks._manifest(spark, f"{marts}/{mart}", numbers[-1])
        touched = {p for p, w in after["partitions"].items() if before[name]["partitions"].get(p) != w}
        if name not in written:
            assert not touched
        elif written[name] is not None:
            series = SERIES[name]
            days = {date(q.year, q.month + series.month, 1) for q in written[name]}
            assert {p.split(f"{series.time}=")[1] for p in touched} <= {d.isoformat() for d in days}
            assert len(written[name]) <= 2
    assert "q14_finance_year" not in written
    inner = quarter == date(1998, 4, 1)
    assert ("q20_region_share" in written) == (quarter == STAR_MED.prior)
    assert ("q42_kpi_table" in written) == (not inner)
    assert written["q09_market_yoy"] == {quarter, date(quarter.year + 1, quarter.month, 1)}


def test_what_a_quarter_reaches():
    assert reached("q09_market_yoy", STAR_SPECS, [date(1998, 4, 1)]) == {date(1998, 4, 1), date(1999, 4, 1)}
    assert reached("q09_market_yoy", STAR_SPECS, [date(1995, 4, 1)]) is None
    assert reached("q25_region_yoy", STAR_SPECS, [date(1995, 4, 1)]) == {date(1995, 4, 1), date(1996, 4, 1)}
    assert reached("q20_region_share", STAR_SPECS, [date(1998, 4, 1)]) == frozenset()
    assert reached("q21_total_growth", STAR_SPECS, [STAR_MED.prior]) is None
    assert reached("q12_result_med", STAR_SPECS, [STAR_MED.current]) == frozenset()
    assert all(reached(n, STAR_SPECS, [STAR_MED.current]) is not None or n for n in JOBS)


def test_headers_read_the_first_bytes_only(spark, tmp_path):
    line = "1," + "x" * 1000 + ",5\n"
    for name in ("a.csv", "b.csv"):
        with open(tmp_path / name, "w") as file:
            file.write("﻿registro,operadora,mar_21\n")
            file.writelines(line for _ in range(20_000))  # several blocks of a split
    context = spark.sparkContext
    statistics = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file")
    context.setJobGroup("headers", "no job is expected")
    try:
        before = statistics.getLong("bytesRead")
        found = headers(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"])
        read = statistics.getLong("bytesRead") - before
        assert not context.statusTracker().getJobIdsForGroup("headers")
    finally:
        context._jsc.clearJobGroup()
    assert set(found.values()) == {"registro,operadora,mar_21"} and len(found) == 2
    assert read < 200_000 < 40_000_000
    assert len(headers(spark, [f"file://{tmp_path}/*.csv"])) == len(headers(spark, [f"file://{tmp_path}"])) == 2
    with pytest.raises(FileNotFoundError):
        headers(spark, [f"file://{tmp_path}/missing.csv"])


def test_compressed_headers(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "c.csv.gz", "wt") as file:
        file.write("registro,operadora,mar_21\n1,A,5\n")
    assert list(headers(spark, [f"file://{tmp_path}/c.csv.gz"]).values()) == ["registro,operadora,mar_21"]


def test_partition_listing_needs_no_files(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    sinks.write_partitions(table(spark, ("MED", A, 1), ("ODO", B, 3)), root, BY)
    (tmp_path / "t" / "segmento=MED" / "trimestre=2030-01-01").mkdir()  # a folder without files is no partition
    assert sinks.partitions(spark, root) == [
        {"segmento": "MED", "trimestre": A.isoformat()}, {"segmento": "ODO", "trimestre": B.isoformat()},
    ]
    assert sinks.partitions(spark, f"{root}/missing") == []


def test_rows_that_are_needed_are_counted_as_they_are_written(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    with pytest.raises(sinks.NoRows, match="no B"):
        sinks.write_partitions(table(spark, ("MED", A, 1)), root, BY, None, [(F.col("trimestre") == B, "no B")])
    assert FrameInputs(spark).held((MED1,), set(), [A]).count() == 0
