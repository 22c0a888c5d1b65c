"""Token ids in Arrow files of equal-length sequences.

Documents are sorted by id over the whole corpus; each task encodes its range with the tokenizers library and packs
the ids, each document followed by the end id, into sequences of SEQUENCE ids. A file (Arrow IPC) has batches of
fixed-size lists: `ids`, and `mask` of the same length (true where an id counts; only a file's last sequence has
padding). Ids take 16 bits where the vocabulary allows it. Any sequence can be read in place from a memory map.
Beside it lies an index file with each document's id, place in the file and number of ids; `read` follows it.

Tasks write to names of their own and rename when complete, so an attempt that dies leaves nothing under the final
name and a repeated task replaces equal content. Only the number of ids per file goes to the driver.

The library encodes each distinct piece between blanks once (its rules drop white space and never look across it);
a worker remembers pieces in two generations of `CACHE_ENTRIES` each, which changes speed only.

Nulls: a null text is empty and has the end id alone; documents with a null id come first. Repeated documents are
written once each, in one run. An empty table gives no files. Memory follows `SLICE_BYTES` or the longest text.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import frames, pieces, words

SEQUENCE = 2048
BATCH_SEQUENCES = 256
END_ID = 1
#: Pieces that a worker remembers, in each of two generations, and the longest of them in bytes.
CACHE_ENTRIES = 400_000
CACHED_LENGTH = 64
#: Pieces that the library gets at a time.
LEARNT = 20_000
SHARE_BYTES = 4 << 20

def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that the tokenizer's rules treat alike alone and in the text: the bytes to encode, starts and ends.

    They are cut at white space and, unless the texts may hold special tokens, also between a plain letter and a
    plain mark after it, so that fewer pieces differ. For the same reason A-Z are lower-cased, unless a combining
    mark might join a capital to another character than it would join the small letter to.
    """
    points, at = pieces.code_points(data)
    kind = pieces.classes()[points]
    if not (kind == pieces.MARK).any():
        data = words.lowered(data)
    inside = kind != pieces.SPACE
    if at is not None:
        inside = np.repeat(inside, np.diff(at, append=len(data)))
    start, end, _ = words.runs(inside, bounds)
    if b"<|" not in data.tobytes():
        letter = words.LETTERS[data]
        mark = (data < 128) & ~words.ALPHANUMERIC[data] & inside & ~letter
        starts, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        starts[1:-1] = ends[1:-1] = letter[:-1] & mark[1:]
        starts[bounds] = ends[bounds] = False
        starts[start] = ends[end] = True
        start, end = np.flatnonzero(starts), np.flatnonzero(ends)
    return data, start, end


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the machine already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo = pieces.Memo(self._learn, CACHE_ENTRIES, CACHED_LENGTH, self.kind)

    def _learn(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that lie one after the other, by the library, and the number of ids of each."""
        offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes())
        column = pa.Array.from_buffers(pa.large_string(), len(ends), [None, offsets, pa.py_buffer(data.tobytes())])
        ids, counts = [], []
        for at in range(0, len(ends), LEARNT):
            found = self.tokenizer.encode_batch_fast(column.slice(at, LEARNT).to_pylist(), add_special_tokens=False)
            lists = [x.ids for x in found]
            counts.append(np.fromiter(map(len, lists), np.int64, len(lists)))
            ids.append(np.fromiter(chain.from_iterable(lists), self.kind, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_column(self, column: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, the end id after each, and where each text's begin, and the end."""
        data, bounds = words.text_bytes(column)
        data, start, end = cut(data, bounds)
        ids, counts = self.memo.encode(data, start, end)
        first = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(start, bounds)]
        ids = np.insert(ids, first[1:], end_id)
        return ids, first + np.arange(len(first))

    def encode(self, texts: list[str], end_id: int = END_ID) -> list[bytes]:
        """Ids of each text and the end id, as bytes of the encoder's kind."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()), end_id)
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class SequenceWriter:
    """Packs ids into sequences and appends them to an Arrow file, batch by batch."""

    def __init__(self, sink, kind: np.dtype, length: int):
        self.kind, self.length = kind, length
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.size = 0
        self.total = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BATCH_SEQUENCES * self.length * self.kind.itemsize:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.frombuffer(b"".join(self.held), self.kind)
        whole = len(values) // self.length
        rest = values[whole * self.length :]
        counted = np.full(whole, self.length, np.int32)
        self.held, self.size = [rest.tobytes()], rest.nbytes
        values = values[: whole * self.length]
        if last and len(rest):
            values = np.concatenate([values, rest, np.zeros(self.length - len(rest), self.kind)])
            counted = np.append(counted, np.int32(len(rest)))
        for at in range(0, len(counted), BATCH_SEQUENCES):
            own = counted[at : at + BATCH_SEQUENCES]
            flat = values[at * self.length : (at + len(own)) * self.length]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length)
            true = pa.array((np.arange(self.length) < own[:, None]).ravel())
            masks = pa.FixedSizeListArray.from_arrays(true, self.length)
            self.file.write_batch(pa.record_batch([lists, masks], schema=self.schema))
            self.total += int(own.sum())

    def close(self) -> None:
        self._flush(True)
        self.file.close()


def _replace(store: pafs.FileSystem, source: str, target: str) -> None:
    if store.get_file_info(target).type != pafs.FileType.NotFound and not isinstance(store, pafs.LocalFileSystem):
        store.delete_file(target)
    store.move(source, target)


def write(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    length: int = SEQUENCE,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Write the ids of all documents, in ascending order of their ids, below `folder` (a URI that all executors reach).

    Returns a row per file, made by the tasks as they write: part, file, documents, tokens.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path), TaskContext.get().partitionId()
        store, place = pafs.FileSystem.from_uri(folder)
        name, ids, sizes = f"part-{part:06d}", [], []
        temporary = f"{place}/.{name}-{uuid.uuid4().hex}"
        writer = None
        for batch in frames.slices(batches, limit=SHARE_BYTES):
            if writer is None:
                store.create_dir(place, recursive=True)
                sink = store.open_output_stream(f"{temporary}.ids")
                writer = SequenceWriter(sink, own.kind, length)
            encoded, places = own.encode_column(batch.column("text"))
            writer.add(encoded.tobytes())
            ids.append(batch.column("doc_id"))
            sizes.append(np.diff(places))
        if writer is None:
            return
        writer.close()
        sink.close()
        counts = np.concatenate(sizes)
        columns = [pa.concat_arrays(ids), pa.array(np.cumsum(counts) - counts), pa.array(counts)]
        with store.open_output_stream(f"{temporary}.index") as out:
            index = pa.table(columns, ["doc_id", "first", "n_tokens"])
            with pa.ipc.new_file(out, index.schema) as file:
                file.write_table(index)
        for kind in ("ids", "index"):
            _replace(store, f"{temporary}.{kind}", f"{place}/{name}.{kind}")
        rows = {"part": [part], "file": [name], "documents": [len(counts)], "tokens": [writer.total]}
        yield pa.RecordBatch.from_pydict(rows)

    rows = frames.texts(docs, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return ordered.mapInArrow(run, "part long, file string, documents long, tokens long")


def _documents(file: pa.ipc.RecordBatchFileReader, index: pa.Table) -> Iterator[tuple[int, bytes]]:
    """Each row of the index with its ids, as little-endian 32-bit integers; batches are read one after the other."""
    ends = np.cumsum(index.column("n_tokens").to_numpy()).tolist()
    row, at, held = 0, 0, []
    for k in range(file.num_record_batches):
        batch = file.get_batch(k)
        values = batch.column("ids").flatten().to_numpy(zero_copy_only=True)
        values = values[: batch.column("mask").flatten().true_count]
        start = 0
        while row < len(ends) and ends[row] <= at + len(values):
            stop = ends[row] - at
            yield row, b"".join([*held, values[start:stop].astype("<u4").tobytes()])
            held, start, row = [], stop, row + 1
        held.append(values[start:].astype("<u4").tobytes())
        at += len(values)


def read(files: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """Per document of the files: doc_id, start (ids before it in all files) and ids (little-endian 32-bit integers).

    `files` is what `write` returned, as a table: part, file, documents, tokens.
    """
    rows = files.select("part", "file", "tokens").orderBy("part").collect()
    before = np.concatenate([[0], np.cumsum([r.tokens for r in rows])]).astype(int).tolist()
    places = [(r.file, before[k]) for k, r in enumerate(rows)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, offset in zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), strict=True):
                with store.open_input_file(f"{place}/{name}.index") as source:
                    index = pa.ipc.open_file(source).read_all().combine_chunks()
                doc_id, first = index.column("doc_id"), index.column("first").to_numpy() + offset
                local = isinstance(store, pafs.LocalFileSystem)
                source = pa.memory_map(f"{place}/{name}.ids") if local else store.open_input_file(f"{place}/{name}.ids")
                with source:
                    found, size, done = [], 0, 0
                    for row, ids in _documents(pa.ipc.open_file(source), index):
                        found.append(ids)
                        size += len(ids)
                        if size >= frames.SLICE_BYTES or row + 1 == index.num_rows:
                            own = doc_id.slice(done, len(found)).combine_chunks()
                            columns = [own, pa.array(first[done : row + 1]), pa.array(found, pa.binary())]
                            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "ids"])
                            found, size, done = [], 0, row + 1

    spark = files.sparkSession
    places_frame = spark.createDataFrame(places, "file string, offset long")
    spread = places_frame.repartitionByRange(max(len(places), 1), "offset")
    return spread.mapInArrow(run, f"doc_id {id_type}, start long, ids binary")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the files below the shared folder, read them back, and describe each document's ids."""
    folder = frames.shared_folder(docs.sparkSession, "token-files")
    files = frames.checkpointed(write(docs, folder, path))
    return read(files, folder, dict(docs.dtypes)["doc_id"]).select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
