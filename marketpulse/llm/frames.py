"""Helpers that the operators share: input columns, Arrow batches cut by bytes, packaged code on executors, shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of text that a task works on at a time. A longer text is worked on alone.
SLICE_BYTES = 2 << 20

#: Bytes of an Arrow batch, of which a task's JVM and its Python worker each hold a copy; 10,000 texts may be 30 MB.
BATCH_BYTES = 4 << 20

#: A key that has more than one in so many of all rows is joined by broadcast; there are fewer of them than this.
HOT_SHARE = 4096

#: Narrow rows of one key that a task joins easily.
EASY_ROWS = 1 << 22


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where executors see the same code folder.

    On a cluster without one, install the package or add it with addPyFile. Arrow batches are bounded by bytes, too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine's own if it names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        root = context.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read from there."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(frame.sparkSession))
    return frame.checkpoint()


def join_counted(
    rows: DataFrame, table: DataFrame, on: Sequence[str], count: str, total: int, easy: int = 0
) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose column `count` (left out) has the key's number of rows.

    `total` is the number of rows or more. Hot keys are fewer than HOT_SHARE, so that their rows are joined where they
    are; of any other key a task gets at most total / HOT_SHARE rows. If all rows are at most `easy`, no key has more,
    and the join is left plain.
    """
    if total <= easy:
        return rows.join(table.drop(count), on)
    hot = F.broadcast(table.where(F.col(count) * HOT_SHARE > total).drop(count))
    often = rows.join(hot, on)
    seldom = rows.join(hot.select(*on), on, "left_anti").join(table.drop(count), on)
    return often.union(seldom)


def texts(frame: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """The named columns under fixed names, whatever other columns the frame has; a null text is empty."""
    ship(frame.sparkSession)
    columns = [frame[id_col].alias("doc_id"), F.coalesce(frame[text_col], F.lit("")).alias("text")]
    return frame.select(*columns, *(frame[column].alias(name) for name, column in more.items()))


def strings(column: pa.Array) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a piece holds at most `limit` bytes of text or a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)
