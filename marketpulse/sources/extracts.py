"""Landing of published crosstab extracts, kept as text files."""

from __future__ import annotations

import csv
from collections.abc import Collection, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from marketpulse.functions.names import clean_names
from marketpulse.functions.periods import QUARTER_ENDS
from marketpulse.operators.crosstab import to_fact, totals, union_extracts
from marketpulse.sinks import REQUESTS, file_system
from marketpulse.spec import SegmentSpec


@dataclass(frozen=True)
class Extract:
    """Files of one crosstab request: which dimension is spread over their columns,
    and the quarter if the request was for a single one."""

    paths: tuple[str, ...]
    coluna: str
    competencia: date | None = None
    sep: str = ","
    thousands: str = ""
    months: tuple[int, ...] = QUARTER_ENDS


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files that a path, folder or pattern names."""
    fs, place = file_system(spark, path)
    found = []
    for status in fs.globStatus(place) or ():
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        names = [(f.getPath().toString(), f.getPath().getName()) for f in inside if f.isFile()]
        found += [full for full, name in names if not name.startswith(("_", "."))]
    if not found:
        raise FileNotFoundError(path)
    return found


def _first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a file, from its first bytes; compressed files are read through their codec."""
    fs, place = file_system(spark, path)
    jvm = spark._jvm
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration()).getCodec(place)
    stream = fs.open(place)
    try:
        text = stream if codec is None else codec.createInputStream(stream)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
    finally:
        stream.close()


def headers(spark: SparkSession, paths: Collection[str]) -> dict[str, str]:
    """The first line of every file, read by the driver while the plan is made: a few requests at a time, no job."""
    with ThreadPoolExecutor(REQUESTS) as pool:
        files = sorted({f for found in pool.map(lambda p: _files(spark, p), sorted(set(paths))) for f in found})
        lines = list(pool.map(lambda f: _first_line(spark, f), files))
    found = {f: line.removeprefix("\ufeff") for f, line in zip(files, lines, strict=True) if line}
    if len(found) < len(files):
        raise ValueError(f"{len(files) - len(found)} of the files {files} have no header")
    return found


def read_text_crosstab(spark: SparkSession, paths: Sequence[str], sep: str = ",") -> list[DataFrame]:
    """Every cell as text: one frame for all files that share a header."""
    groups: dict[str, list[str]] = {}
    for path, header in sorted(headers(spark, paths).items()):
        groups.setdefault(header, []).append(path)
    frames = []
    for header, files in groups.items():
        names = next(csv.reader([header], delimiter=sep))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        reader = spark.read.schema(schema).option("header", True).option("sep", sep)
        frames.append(clean_names(reader.csv(files)))
    return frames


def _tables(spark: SparkSession, extract: Extract, tables: Sequence[DataFrame] | None) -> Sequence[DataFrame]:
    return read_text_crosstab(spark, extract.paths, extract.sep) if tables is None else tables


def read_extract(
    spark: SparkSession, extract: Extract, spec: SegmentSpec, tables: Sequence[DataFrame] | None = None
) -> DataFrame:
    """Long fact of one extract, holding the dimensions that the extract has.

    Files are unpivoted header by header: each brings its own period columns, and
    after the unpivot they all have the same few. ``tables`` are the extract's
    text crosstabs, if they have been read already.
    """
    facts = [
        to_fact(
            table,
            extract.coluna,
            spec.segmento,
            extract.competencia,
            months=extract.months,
            thousands=extract.thousands,
        )
        for table in _tables(spark, extract, tables)
    ]
    return union_extracts(facts)


def read_totals(
    spark: SparkSession, extract: Extract, spec: SegmentSpec, tables: Sequence[DataFrame] | None = None
) -> DataFrame | None:
    """The total column of a snapshot by operator; None if the extract is something else."""
    if extract.competencia is None:
        return None
    found = [
        totals(t, spec.segmento, extract.competencia, extract.thousands)
        for t in _tables(spark, extract, tables)
    ]
    found = [t for t in found if t is not None]
    return union_extracts(found) if found else None
