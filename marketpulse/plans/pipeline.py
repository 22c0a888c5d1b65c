"""Landing the inputs once, and writing every result as a mart.

The landed tables are the cut in the lineage: the marts read pruned files
instead of repeating the joins, and a lost executor costs a re-read, not a
recomputation of the inputs.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Mapping, Sequence
from datetime import date
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions.numeric import guarded_sum, sum_with_holes
from marketpulse.operators.crosstab import MEASURE, unite
from marketpulse.plans.catalog import JOBS, SERIES, lacks, reached
from marketpulse.schema import ENROLMENT
from marketpulse.sinks import NoRows, Partition, publish, remove, write_partitions
from marketpulse.sources.extracts import Extract, read_extract, read_text_crosstab, read_totals
from marketpulse.sources.files import LedgerFiles, MemberFiles
from marketpulse.sources.inputs import (
    DIMENSIONS,
    Cut,
    Inputs,
    LandedInputs,
    MissingPeriod,
    Selected,
    compared_periods,
)
from marketpulse.sources.ledger import unite as unite_ledgers
from marketpulse.spec import SegmentSpec, all_quarters, later

SHARED_DIRECTORY = "spark.checkpoint.dir"


def shared_directory(spark: SparkSession) -> str:
    """The folder that every executor sees, as the cluster names it."""
    path = spark.conf.get(SHARED_DIRECTORY, None)
    if not path:
        raise ValueError(f"{SHARED_DIRECTORY} is not set; name a folder shared by all executors")
    return path.rstrip("/")


#: Roll-ups of the joint cut that are landed beside it: each family of results reads its own.
ROLL_UPS = (
    frozenset({"registro", "operadora"}),
    frozenset({"registro", "operadora", "modalidade"}),
    frozenset({"registro", "regiao"}),
    frozenset({"modalidade"}),
    frozenset({"regiao"}),
)


def _enrolment_path(root: str, dims: Collection[str] = DIMENSIONS) -> str:
    if frozenset(dims) == frozenset(DIMENSIONS):
        return f"{root}/enrolment"
    return f"{root}/enrolment-by-{'-'.join(d for d in DIMENSIONS if d in dims)}"


def _of_quarters(specs: Sequence[SegmentSpec], quarters: Collection[date]):
    """Partitions of the segments and quarters."""
    segments, names = {s.segmento for s in specs}, {q.isoformat() for q in quarters}
    return lambda p: p["segmento"] in segments and p["competencia"] in names


def land_quarters(
    inputs: Inputs, specs: Sequence[SegmentSpec], root: str, quarters: Collection[date]
) -> None:
    """Write the enrolment fact of some quarters; every other quarter stays as it is."""
    fact = inputs.enrolment(specs, DIMENSIONS, quarters)
    cells = fact.groupBy("segmento", "competencia", *DIMENSIONS).agg(
        guarded_sum(F.col("beneficiarios")).alias("beneficiarios")
    )
    asked = _of_quarters(specs, quarters)
    path = _enrolment_path(root)
    compared = [
        ((F.col("segmento") == segmento) & (F.col("competencia") == F.lit(quarter)), text)
        for segmento, quarter, text in compared_periods(specs, quarters)
    ]
    try:
        write_partitions(cells, path, ["segmento", "competencia"], asked, compared)
    except NoRows as none:
        raise MissingPeriod(str(none)) from none
    joint = inputs.spark.read.schema(ENROLMENT).parquet(path).filter(
        F.col("segmento").isin([s.segmento for s in specs])
        & F.col("competencia").isin(sorted(quarters))
    )
    for dims in ROLL_UPS:
        keys = ["segmento", "competencia", *[d for d in DIMENSIONS if d in dims]]
        rolled = sum_with_holes(joint, keys, MEASURE)
        write_partitions(rolled, _enrolment_path(root, dims), ["segmento", "competencia"], asked)


def land_ledger(
    inputs: Inputs, specs: Sequence[SegmentSpec], root: str, years: Collection[int] | None = None
) -> None:
    """Write the ledger of some years, or all of it; other years and segments stay as they are."""
    ledger = inputs.ledger(specs, years)
    segments = {s.segmento for s in specs}

    def asked(p: Partition) -> bool:
        return p["segmento"] in segments and (years is None or int(p["ano"]) in years)

    rows = ledger.groupBy(*[c for c in ledger.columns if c != "saldo_cents"]).agg(
        F.sum("saldo_cents").alias("saldo_cents")
    )
    write_partitions(
        rows.withColumn("ano", F.year("ano_tri")), f"{root}/ledger", ["segmento", "ano"], asked
    )


def land_members(inputs: Inputs, specs: Sequence[SegmentSpec], root: str) -> None:
    """The lists row by row, so that their length can still be counted."""
    segments = {s.segmento for s in specs}
    write_partitions(
        inputs.members(specs), f"{root}/members", ["segmento"], lambda p: p["segmento"] in segments
    )


def landed(spark: SparkSession, root: str) -> LandedInputs:
    return LandedInputs(
        spark,
        {d: _enrolment_path(root, d) for d in (frozenset(DIMENSIONS), *ROLL_UPS)},
        members=f"{root}/members",
        ledger=f"{root}/ledger",
    )


def land(inputs: Inputs, specs: Sequence[SegmentSpec], root: str) -> LandedInputs:
    """Write everything that the jobs read, and return inputs that read it."""
    anchor = {q for s in specs for q in s.anchor_quarters}
    land_quarters(inputs, specs, root, anchor | set(all_quarters(specs)))
    land_members(inputs, specs, root)
    land_ledger(inputs, specs, root)
    return landed(inputs.spark, root)


def land_extracts(
    spark: SparkSession,
    extracts: Iterable[tuple[Extract, SegmentSpec]],
    path: str,
    totals_path: str | None = None,
) -> list[Cut]:
    """Published text crosstabs of one kind -> one landed cut of the enrolment fact.

    All requests are united before anything is written; a cell that two of them
    give is an error. Snapshots by operator also bring the published total of
    each operator, which becomes a cut of its own at ``totals_path``.
    """
    extracts = list(extracts)
    read = [
        (extract, spec, read_text_crosstab(spark, extract.paths, extract.sep)) for extract, spec in extracts
    ]
    cells = unite([read_extract(spark, *one) for one in read])
    cuts = [_land_cut(cells, path)]
    if totals_path is not None:
        found = [read_totals(spark, *one) for one in read]
        found = [t for t in found if t is not None]
        if found:
            cuts.append(_land_cut(unite(found), totals_path))
    return cuts


def _land_cut(cells: DataFrame, path: str) -> Cut:
    write_partitions(cells, path, ["segmento", "competencia"])
    return Cut(frozenset(set(cells.columns) & set(DIMENSIONS)), path)


def land_files(
    spark: SparkSession,
    root: str,
    crosstabs: Mapping[str, Sequence[tuple[Extract, SegmentSpec]]],
    members: Sequence[MemberFiles],
    ledgers: Sequence[LedgerFiles],
) -> LandedInputs:
    """Raw files of every kind -> landed tables, and inputs that read them.

    ``crosstabs`` names each kind of request; a kind becomes a cut, and one of
    totals if its requests are snapshots by operator.
    """
    cuts = []
    for name, requests in crosstabs.items():
        cuts += land_extracts(spark, requests, f"{root}/cut-{name}", f"{root}/cut-{name}-total")
    lists = [m.read(spark) for m in members]
    if lists:
        every = lists[0]
        for one_list in lists[1:]:
            every = every.unionByName(one_list, allowMissingColumns=True)
        write_partitions(every, f"{root}/members", ["segmento"])
    rows = [ledger.read(spark) for ledger in ledgers]
    if rows:
        every = unite_ledgers(rows).withColumn("ano", F.year("ano_tri"))
        write_partitions(every, f"{root}/ledger", ["segmento", "ano"])
    return LandedInputs(spark, cuts, members=f"{root}/members", ledger=f"{root}/ledger")


def mart_name(query: str) -> str:
    """``q09_market_yoy`` -> ``market_yoy``."""
    return query.split("_", 1)[1]


def build_marts(
    inputs: Inputs, specs: Sequence[SegmentSpec], names: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """The named results, not yet computed; by default all that the segments allow."""
    if names is None:
        names = [n for n in JOBS if not lacks(n, specs)]
    names = list(names)
    for name in names:
        if missing := lacks(name, specs):
            raise ValueError(f"{name} needs the segments {sorted(missing)} too")
    return {n: JOBS[n](inputs, specs) for n in names}


def _publish(table: DataFrame, marts: str, name: str, asked) -> None:
    """Series by segment and quarter, other results by segment where they have one."""
    if "segmento" not in table.columns:
        publish(table, marts, mart_name(name))
        return
    time = [SERIES[name].time] if name in SERIES else []
    publish(table, marts, mart_name(name), ["segmento", *time], asked)


def rebuild(
    inputs: LandedInputs,
    specs: Sequence[SegmentSpec],
    marts: str,
    quarters: Collection[date],
    names: Iterable[str] | None = None,
) -> dict[str, frozenset[date] | None]:
    """Write again what changed quarters reach, and nothing else.

    A series is built for the quarters reached, from those and the ones that
    they are compared with, and only their partitions are written. Returns what
    was written: the quarters of each series, or None for a whole result.
    """
    segments = {s.segmento for s in specs}
    names = [n for n in JOBS if not lacks(n, specs)] if names is None else list(names)
    anchor = {q for s in specs for q in s.anchor_quarters}
    written: dict[str, frozenset[date] | None] = {}
    for name in names:
        part = reached(name, specs, quarters)
        if part is not None:
            part &= frozenset(all_quarters(specs))
            if not part:
                continue
        source = inputs
        if part is not None:
            series = SERIES[name]
            span = [later(q, -k) for q in part for k in range(5)]
            if series.counted:
                around = set(all_quarters(specs)) & {later(q, k) for q in quarters for k in range(-4, 5)}
                whole = len(inputs.pairs_held(specs, set(), around)) == len(specs) * len(around)
                part = part if whole else None
            if part is not None:
                source = Selected(inputs, {*span, *(anchor if series.anchored else ())})
        if part is None:
            _publish(JOBS[name](source, specs), marts, name, lambda p: p["segmento"] in segments)
        else:
            days = {date(q.year, q.month + series.month, 1) for q in part}
            table = JOBS[name](source, specs).filter(F.col(series.time).isin(sorted(days)))
            texts = {d.isoformat() for d in days}
            _publish(table, marts, name, lambda p: p["segmento"] in segments and p[series.time] in texts)
        written[name] = part
    return written


def refresh(
    inputs: Inputs,
    specs: Sequence[SegmentSpec],
    landing: str,
    marts: str,
    quarters: Collection[date],
    names: Iterable[str] | None = None,
) -> dict[str, frozenset[date] | None]:
    """Land some quarters, and write the marts again as far as these quarters reach."""
    land_quarters(inputs, specs, landing, quarters)
    return rebuild(landed(inputs.spark, landing), specs, marts, quarters, names)


def run(
    inputs: Inputs,
    specs: Sequence[SegmentSpec],
    marts: str,
    names: Iterable[str] | None = None,
    landing: str | None = None,
) -> None:
    """Land the inputs and write the marts.

    ``landing`` keeps the landed tables for later runs; without it they go to a
    new folder under the cluster's shared one, which is removed at the end. A
    mart of some of the segments replaces these segments; ``sinks.read_mart``
    reads it.
    """
    root = landing or f"{shared_directory(inputs.spark)}/inputs-{uuid4().hex}"
    segments = [s.segmento for s in specs]
    try:
        source = land(inputs, specs, root)
        for name, table in build_marts(source, specs, names).items():
            _publish(table, marts, name, lambda p: p["segmento"] in segments)
    finally:
        if landing is None:
            remove(inputs.spark, root)
