"""Association members: the flag, the anchored operator panel, the totals row."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.spec import SegmentSpec, pick


def member_ids(members: DataFrame) -> DataFrame:
    """Each member once per segment, so that a join cannot fan out."""
    return members.select("segmento", "registro").distinct()


def flag_members(df: DataFrame, members: DataFrame) -> DataFrame:
    """``associada``: 1 if the row's operator is on its segment's list, else 0.

    Callers aggregate to operators first: the join then sees one row per
    operator (and period), however many fact rows one operator has. The list's
    size decides between broadcast and sort-merge, at run time.
    """
    ids = member_ids(members).withColumn("associada", F.lit(1))
    return df.join(ids, ["segmento", "registro"], "left").withColumn(
        "associada", F.coalesce("associada", F.lit(0))
    )


def anchored_panel(
    fact: DataFrame, specs: Sequence[SegmentSpec], quarters: Sequence[date]
) -> DataFrame:
    """Operators seen in the anchor year, with their lives in every quarter (0 where missing).

    One row per (registro, operadora) and one column per quarter, so anchoring
    and the gap-free period axis come out of a single aggregation, with neither
    a self join nor a product of operators and periods.
    """
    cells = [
        F.expr(
            f"coalesce(sum(if(competencia = DATE'{q}', beneficiarios, null)), 0L)"
        ).alias(q.isoformat())
        for q in quarters
    ]
    anchored = F.max(F.year("competencia") == pick(specs, lambda s: s.anchor_year))
    return (
        fact.groupBy("segmento", "registro", "operadora")
        .agg(anchored.alias("_anchored"), *cells)
        .filter("_anchored")
        .drop("_anchored")
    )


def panel_rows(panel: DataFrame, quarters: Sequence[date]) -> DataFrame:
    """The panel in long form; ``competencia`` is still the column name, as text."""
    cells = [q.isoformat() for q in quarters]
    keys = [c for c in panel.columns if c not in cells]
    return panel.unpivot(keys, cells, "competencia", "beneficiarios")


def keep_held(df: DataFrame, held: DataFrame) -> DataFrame:
    """Keeps the quarters that the inputs have: one that was never landed has no rows, not zeros.

    ``held`` has at most a row for each segment and quarter of a request, so its
    size lets it be broadcast.
    """
    return df.join(held, ["segmento", "competencia"], "left_semi")


def keep_requested(
    df: DataFrame, specs: Sequence[SegmentSpec], quarters: Sequence[date]
) -> DataFrame:
    """Keeps each segment to its own quarters where the segments' ranges differ."""
    if all(s.first_quarter <= min(quarters) and max(quarters) <= s.last_quarter for s in specs):
        return df
    at = F.col("competencia")
    first = pick(specs, lambda s: s.first_quarter)
    return df.filter((at >= first) & (at <= pick(specs, lambda s: s.last_quarter)))


def append_total(df: DataFrame, sums: Sequence[str], labels: dict[str, str]) -> DataFrame:
    """Append one row with the sums of ``sums``; ``labels`` fills the text columns."""
    total = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    return df.unionByName(total.withColumns({c: F.lit(v) for c, v in labels.items()}))
