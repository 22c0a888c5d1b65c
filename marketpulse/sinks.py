"""Partitioned Parquet for landed inputs, and published marts that readers see whole.

A published mart keeps each write in a folder of its own. A manifest names, for
every partition, the write that holds it; it is written under a temporary name
and gets its number by a rename that must find that number free. A reader takes
the manifest of the highest number, so it sees either the mart as it was or the
mart as it is, also if a writer dies in between; of two writers that start from
the same manifest the later one fails.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Partition = Mapping[str, str]

#: Requests that the driver has open at a time at the file system.
REQUESTS = 16


# Files


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _children(spark: SparkSession, path: str, folders: bool) -> list[str]:
    """Names of the folders, or of the data files, directly in a folder; none if it is not there."""
    fs, place = file_system(spark, path)
    if not fs.exists(place):
        return []
    found = fs.listStatusIterator(place)
    names = []
    while found.hasNext():
        status = found.next()
        name = status.getPath().getName()
        if status.isDirectory() == folders and not name.startswith(("_", ".")):
            names.append(name)
            if not folders:
                break  # one file is enough
    return names


def partitions(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """The partitions that have files below ``path``, from its folders; no list of all files is made."""
    level, found = [""], []
    with ThreadPoolExecutor(REQUESTS) as pool:
        while level:
            inside = pool.map(lambda at: [n for n in _children(spark, f"{path}{at}", True) if "=" in n], level)
            below = [(at, names) for at, names in zip(level, inside, strict=True)]
            leaves = [at for at, names in below if not names and at]
            kept = pool.map(lambda at: _children(spark, f"{path}{at}", False), leaves)
            found += [at for at, files in zip(leaves, kept, strict=True) if files]
            level = [f"{at}/{name}" for at, names in below for name in names]
    return [dict(p.split("=", 1) for p in folder.split("/")[1:]) for folder in sorted(found)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote."""
    fs, folder = file_system(spark, path)
    fs.delete(folder, True)


def _read_text(spark: SparkSession, path: str) -> str:
    fs, place = file_system(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, place = file_system(spark, path)
    stream = fs.create(place, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


# Landed tables


class NoRows(LookupError):
    """What was written has no rows where some are needed."""


def write_partitions(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    asked: Callable[[Partition], bool] | None = None,
    needed: Sequence[tuple[Column, str]] = (),
) -> None:
    """Write ``df``, replacing the partitions it has rows for.

    ``asked`` tells which partitions the rows are meant to replace: those of
    them that have no rows any more are removed. All others stay as they are.
    ``needed`` are conditions that some written row must meet; the rows are
    counted as they are written, and an error with the condition's text is
    raised before anything is removed. The rebalance hint gathers each
    partition's rows into files of the advisory size and splits a large
    partition over several tasks.
    """
    written = Observation()
    names = F.collect_set(F.concat_ws("/", *[F.col(c).cast("string") for c in by]))
    counts = [F.count_if(condition).alias(f"needed_{k}") for k, (condition, _) in enumerate(needed)]
    (
        df.observe(written, names.alias("names"), *counts)
        .hint("rebalance", *[F.col(c) for c in by])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*by)
        .parquet(path)
    )
    if asked is None and not needed:
        return
    found = written.get
    for k, (_, text) in enumerate(needed):
        if not found[f"needed_{k}"]:
            raise NoRows(text)
    if asked is None:
        return
    kept = set(found["names"])
    for old in partitions(df.sparkSession, path):
        if asked(old) and "/".join(old[c] for c in by) not in kept:
            remove(df.sparkSession, "/".join([path, *[f"{c}={old[c]}" for c in by]]))


def write_mart(df: DataFrame, root: str, name: str, segments: Sequence[str]) -> None:
    """One named result as a plain folder, by segment where it has one: the given segments are replaced."""
    path = f"{root.rstrip('/')}/{name}"
    if "segmento" in df.columns:
        write_partitions(df, path, ["segmento"], lambda p: p["segmento"] in segments)
    else:
        df.write.mode("overwrite").parquet(path)


# Published marts


_NUMBERED = re.compile(r"manifest-(\d{10})\.json")


def _manifests(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests, ascending."""
    fs, place = file_system(spark, f"{folder}/manifests")
    if not fs.exists(place):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(place)]
    return sorted(int(m[1]) for m in map(_NUMBERED.fullmatch, names) if m)


def _manifest(spark: SparkSession, folder: str, number: int) -> dict:
    return json.loads(_read_text(spark, f"{folder}/manifests/manifest-{number:010d}.json"))


def _commit(spark: SparkSession, folder: str, number: int, manifest: dict) -> None:
    """The step at which readers begin to see a write."""
    target = f"{folder}/manifests/manifest-{number:010d}.json"
    temporary = f"{folder}/manifests/.{uuid4().hex}"
    _write_text(spark, temporary, json.dumps(manifest, indent=1))
    fs, source = file_system(spark, temporary)
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    if fs.exists(place) or not fs.rename(source, place):
        fs.delete(source, False)
        raise RuntimeError(f"{target} exists: another writer published first")


def _folder_names(spark: SparkSession, path: str) -> list[str]:
    """Paths of the partition folders below a write; one empty path if it has none."""
    return ["/".join(f"{k}={v}" for k, v in p.items()) for p in partitions(spark, path)]


def publish(
    df: DataFrame,
    root: str,
    name: str,
    by: Sequence[str] = (),
    asked: Callable[[Partition], bool] | None = None,
) -> None:
    """Write rows of a mart and make them visible at once.

    ``asked`` tells which partitions the rows replace, also those left without
    rows; by default all. Writes that neither the new nor the last manifest
    names any more are removed: a reader that holds the last one can go on.
    """
    spark, folder = df.sparkSession, f"{root.rstrip('/')}/{name}"
    numbers = _manifests(spark, folder)
    old = _manifest(spark, folder, numbers[-1]) if numbers else {"by": list(by), "partitions": {}}
    whole = asked is None or old["by"] != list(by)
    write = uuid4().hex
    data = f"{folder}/writes/{write}"
    writer = df.hint("rebalance", *[F.col(c) for c in by]).write.partitionBy(*by) if by else df.write
    writer.parquet(data)
    places = _folder_names(spark, data) if by else [""]

    def stays(place: str) -> bool:
        return not whole and not asked(dict(p.split("=", 1) for p in place.split("/")))

    kept = {place: at for place, at in old["partitions"].items() if stays(place)}
    new = {"by": list(by), "schema": df.schema.json(), "partitions": kept | dict.fromkeys(places, write)}
    _commit(spark, folder, (numbers[-1] if numbers else 0) + 1, new)
    _forget(spark, folder, numbers, old, new)


def _forget(spark: SparkSession, folder: str, numbers: Sequence[int], old: dict, new: dict) -> None:
    """Remove manifests before the last one, and the writes that only they name."""
    used = {*old["partitions"].values(), *new["partitions"].values()}
    for number in numbers[:-1]:
        for write in set(_manifest(spark, folder, number)["partitions"].values()) - used:
            remove(spark, f"{folder}/writes/{write}")
        remove(spark, f"{folder}/manifests/manifest-{number:010d}.json")


def vacuum(spark: SparkSession, root: str, name: str) -> None:
    """Remove what writers that died have left. No writer of the mart may be at work."""
    folder = f"{root.rstrip('/')}/{name}"
    used = {w for n in _manifests(spark, folder) for w in _manifest(spark, folder, n)["partitions"].values()}
    for write in _children(spark, f"{folder}/writes", True):
        if write not in used:
            remove(spark, f"{folder}/writes/{write}")


def _parts(spark: SparkSession, folder: str, manifest: dict) -> Iterator[DataFrame]:
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    writes: dict[str, list[str]] = {}
    for place, write in manifest["partitions"].items():
        writes.setdefault(write, []).append(place)
    for write, places in sorted(writes.items()):
        data = f"{folder}/writes/{write}"
        reader = spark.read.schema(schema).option("basePath", data)
        yield reader.parquet(*[f"{data}/{p}" if p else data for p in sorted(places)]).select(*schema.names)
    if not writes:
        yield spark.createDataFrame([], schema)


def read_mart(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A published mart as its newest manifest has it."""
    folder = f"{root.rstrip('/')}/{name}"
    numbers = _manifests(spark, folder)
    if not numbers:
        raise FileNotFoundError(f"no mart has been published at {folder}")
    return reduce(DataFrame.unionByName, _parts(spark, folder, _manifest(spark, folder, numbers[-1])))
