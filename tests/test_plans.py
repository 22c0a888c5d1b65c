"""What the plans may and may not do, and that results do not depend on join strategies."""

import pathlib
import re

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from marketpulse.plans import enrolment
from marketpulse.plans.catalog import JOBS
from marketpulse.sources.star import STAR_MED, STAR_SPECS, StarInputs

PACKAGE = pathlib.Path(__file__).resolve().parent.parent / "marketpulse"
FORBIDDEN = ("collect(", "toPandas", "udf", "mapPartitions", ".rdd", "localCheckpoint", "crossJoin",
             "applyInPandas", "mapInPandas", "toLocalIterator", ".cache(", ".persist(")


# The optional subpackage is another subject; headers of extract files are read at plan time.
OWN = [p for p in sorted(PACKAGE.rglob("*.py")) if "llm" not in p.relative_to(PACKAGE).parts]
DRIVER_SIDE = {"extracts.py": {"collect("}}


@pytest.mark.parametrize("path", OWN, ids=lambda p: p.name)
def test_no_driver_side_or_python_data_path(path):
    text = path.read_text()
    text = text.replace("F.collect_set(", "")
    assert [w for w in FORBIDDEN if w in text and w not in DRIVER_SIDE.get(path.name, ())] == []


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(JOBS))
def test_no_product_and_no_gathering_of_rows(spark, name):
    plan = physical(JOBS[name](StarInputs(spark, SMALL), STAR_SPECS))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    # Rows are gathered in one task only after they were summed in parallel.
    for line, below in _with_next(plan, "Exchange SinglePartition"):
        assert "partial_" in below, line


def _with_next(plan, text):
    lines = plan.splitlines()
    return [(a, b) for a, b in zip(lines, lines[1:]) if text in a]


def test_scan_reads_only_what_the_query_needs(spark):
    plan = physical(JOBS["q21_total_growth"](StarInputs(spark, SMALL), STAR_SPECS))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    columns = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert columns == {"l_orderkey", "l_quantity", "l_linestatus", "o_orderkey", "o_orderdate"}
    assert "customer" not in plan and "supplier" not in plan
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_orderdate", plan)


def test_window_rows_are_quarters(spark):
    plan = physical(JOBS["q09_market_yoy"](StarInputs(spark, SMALL), STAR_SPECS))
    above, below = plan.split("Window [", 1)
    assert "HashAggregate(keys=[segmento" in below


def test_panel_is_one_aggregation_of_the_fact(spark):
    df = enrolment.market_series(StarInputs(spark, SMALL), STAR_SPECS)
    df.collect()
    plan = physical(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", plan)) == 1


@pytest.mark.parametrize("name", ["q28_individual_total", "q40_share_labels", "q33_finance_var"])
def test_lines_are_read_once(spark, name):
    df = JOBS[name](StarInputs(spark, SMALL), STAR_SPECS)
    df.collect()
    plan = physical(df).split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_orderkey", plan)) == 1


# Queries that join the orders to their operator, by the hot key.
HOT_JOIN = ("q06_anchor_panel", "q09_market_yoy", "q02d_operator_by_modality", "q42_kpi_table")


class HotOperator(StarInputs):
    """Half of all orders belong to one operator, which also has its usual rows."""

    def _table(self, name):
        table = super()._table(name)
        if name != "orders":
            return table
        hot = F.when(F.col("o_orderkey") % 2 == 0, F.lit(1).cast("long"))
        table = table.withColumn("o_custkey", F.coalesce(hot, F.col("o_custkey")))
        # Several map outputs, as from the many files of a large table.
        return table.repartition(8)


@pytest.mark.parametrize(
    "name",
    ["q06_anchor_panel", "q09_market_yoy", "q20_region_share", "q02d_operator_by_modality",
     "q27_individual", "q16_finance_members", "q42_kpi_table"],
)
def test_same_result_with_a_hot_key_and_no_broadcast(spark, name):
    def result():
        df = JOBS[name](HotOperator(spark, SMALL), STAR_SPECS)
        return sorted(map(repr, df.collect())), physical(df).split("== Initial Plan ==")[0]

    expected, plan = result()
    assert "skew=true" not in plan
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got, plan = result()
        assert got == expected
        assert "BroadcastHashJoin" not in plan
        if name in HOT_JOIN:
            assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert expected


class HotSupplier(StarInputs):
    """Half of all lines come from one supplier."""

    def _table(self, name):
        table = super()._table(name)
        if name != "lineitem":
            return table
        hot = F.when(F.col("l_orderkey") % 2 == 0, F.lit(1).cast("long"))
        return table.withColumn("l_suppkey", F.coalesce(hot, F.col("l_suppkey"))).repartition(8)


REGIONAL = ["q02b_period_by_region", "q02f_operator_by_region", "q19_member_region", "q20_region_share",
            "q24_region_compare", "q25_region_yoy"]


@pytest.mark.parametrize("name", REGIONAL)
def test_lines_are_summed_before_the_region_is_looked_up(spark, name):
    plan = physical(JOBS[name](StarInputs(spark, SMALL), STAR_SPECS))
    # Below the sum of the lines stand the lines and the orders alone.
    tree = plan.splitlines()
    first = next(k for k, line in enumerate(tree) if "l_suppkey" in line and "partial_sum" in line)
    depth = len(tree[first]) - len(tree[first].lstrip(" :+-"))
    below = []
    for line in tree[first + 1 :]:
        if len(line) - len(line.lstrip(" :+-")) <= depth:
            break
        below.append(line)
    below = "\n".join(below)
    assert "l_orderkey" in below and not any(c in below for c in ("s_suppkey", "n_nationkey", "r_regionkey"))


@pytest.mark.parametrize("name", ["q25_region_yoy", "q20_region_share"])
def test_same_result_with_a_hot_supplier_and_no_broadcast(spark, name):
    def result():
        return sorted(map(repr, JOBS[name](HotSupplier(spark, SMALL), STAR_SPECS).collect()))

    expected = result()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert result() == expected and expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["q07_market_total", "q08_member_total", "q09_market_yoy", "q31_member_growth"])
def test_operators_are_summed_before_quarters_become_rows(spark, name):
    plan = physical(JOBS[name](StarInputs(spark, SMALL), STAR_SPECS))
    below = plan[plan.index("Expand") :]
    keys = re.search(r"HashAggregate\(keys=\[([^\]]*)\]", below)[1]
    assert "associada" in keys and "registro" not in keys


def test_segment_filter_reaches_the_scan(spark):
    df = JOBS["q32_member_coverage"](StarInputs(spark, SMALL), (STAR_MED,))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_linestatus,O\)", physical(df))
