"""Byte-level BPE by matrices: encoding and decoding with the ranks of a public tokenizer.

A task cuts its texts into words by the tokenizer's pattern and encodes each new distinct word once. Words of a
similar length form a matrix, a row a word, padded to the longest; a second matrix holds the rank of each pair of
neighbours, looked up in a hash table of pairs. Each round, every row merges its leftmost pair of least rank; then the
place that the merge freed is squeezed out, so the matrix loses a column, and rows without any pair left leave it.
A word that is a token itself is that token, as the library has it.

A word longer than LONG is a matrix of one row. There a round merges all pairs of the least rank from the left, as
long as none of the pairs that this makes has as low a rank; if one has, only the leftmost is merged. That gives what
single merges give, in a number of rounds that follows the distinct ranks and not the length.

Decoding gathers the bytes of the tokens. Nulls: a null text is empty and has no ids; a null id stays null. Repeated
documents give a row each; an empty table none. Memory follows `SHARE_BYTES` or the longest text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import frames, pieces, words

#: Words that a worker remembers, in each of two generations, and the longest of them in bytes.
CACHE_ENTRIES = 400_000
CACHED_LENGTH = 64
#: Bytes of text whose new words are encoded together.
SHARE_BYTES = 4 << 20
#: Widths of the matrices; a longer word is a matrix of its own.
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 48, 64)
LONG = WIDTHS[-1]
#: Rows of a matrix at a time.
ROWS = 50_000

_NONE = np.int32(np.iinfo(np.int32).max)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class PairTable:
    """A hash table from pairs of ids to the id of both together, with open addresses; the id is the pair's rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        bits = max(4, int(2 * len(left)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.joined = np.full(1 << bits, _NONE, np.int32)
        keys = self._key(left, right)
        at = self._home(keys)
        todo = np.arange(len(keys))
        while len(todo):  # of those that want one free place, the last gets it
            free = self.keys[at[todo]] == -1
            self.keys[at[todo[free]]] = keys[todo[free]]
            placed = self.keys[at[todo]] == keys[todo]
            self.joined[at[todo[placed]]] = joined[todo[placed]]
            todo = todo[~placed]
            at[todo] = (at[todo] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the largest number where it has none. Padding is negative and has none."""
        keys = self._key(left, right)
        at = self._home(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.joined[at], _NONE)
        todo = np.flatnonzero((held != keys) & (held != -1) & (keys >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.joined[at[todo[hit]]]
            todo = todo[~hit & (held != -1)]
        out[(left < 0) | (right < 0)] = _NONE
        return out


class Ranks:
    """The tokens of a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        size = max(self.of.values()) + 1
        tokens = [b""] * size
        for token, rank in self.of.items():
            tokens[rank] = token
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([self.of[bytes([b])] for b in range(256)], np.int32)
        found = [
            (self.of[token[:k]], self.of[token[k:]], rank)
            for token, rank in self.of.items()
            for k in range(1, len(token))
            if token[:k] in self.of and token[k:] in self.of
        ]
        self.pairs = PairTable(*np.array(found, np.int32).reshape(-1, 3).T)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return pieces.gather(self.data, self.place[ids], self.size[ids])


def merge_rows(symbols: np.ndarray, pairs: PairTable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of symbols, padded with -1, merged until no pair has a rank: numbers of finished rows, and these rows."""
    rows = np.arange(len(symbols))
    width = symbols.shape[1]
    ranks = np.full((len(rows), max(width - 1, 1)), _NONE, np.int32)
    if width > 1:
        ranks = pairs.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(rows), -1)
    while len(rows):
        column = ranks.argmin(axis=1)
        least = ranks[np.arange(len(rows)), column]
        open_ = least != _NONE
        if not open_.all():
            yield rows[~open_], symbols[~open_]
            rows, symbols, ranks, column, least = rows[open_], symbols[open_], ranks[open_], column[open_], least[open_]
            if not len(rows):
                return
        each = np.arange(len(rows))
        symbols[each, column] = least
        stays = np.ones(symbols.shape, bool)
        stays[each, column + 1] = False
        symbols = symbols[stays].reshape(len(rows), -1)
        stays = stays[:, 1:]  # the pair goes whose right symbol went
        ranks = ranks[stays].reshape(len(rows), -1)
        if not ranks.shape[1]:
            yield rows, symbols
            return
        inner = np.flatnonzero(column > 0)
        ranks[inner, column[inner] - 1] = pairs.rank(symbols[inner, column[inner] - 1], least[inner])
        inner = np.flatnonzero(column < symbols.shape[1] - 1)
        ranks[inner, column[inner]] = pairs.rank(least[inner], symbols[inner, column[inner] + 1])


def merge_long(symbols: np.ndarray, pairs: PairTable) -> np.ndarray:
    """One long row, merged until no pair has a rank."""
    ranks = pairs.rank(symbols[:-1], symbols[1:])
    while len(ranks) and (least := ranks.min()) != _NONE:
        at = np.flatnonzero(ranks == least)
        run = np.concatenate([[True], at[1:] != at[:-1] + 1])
        at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
        # What the merges would stand beside, one after the other from the left.
        joined = np.zeros(len(symbols), bool)
        joined[at + 1] = True
        merged = np.full(len(at), least, np.int32)
        inner = at > 0
        left = np.where(joined[at[inner] - 1], least, symbols[at[inner] - 1])
        follows = at + 2 < len(symbols)
        made = [pairs.rank(left, merged[inner]), pairs.rank(merged[follows], symbols[at[follows] + 2])]
        if min((int(m.min()) for m in made if len(m)), default=int(_NONE)) <= least:
            at = at[:1]
        symbols[at] = least
        symbols = np.delete(symbols, at + 1)
        ranks = np.delete(ranks, at)
        now = at - np.arange(len(at))
        for pair in (now[now > 0] - 1, now[now < len(symbols) - 1]):
            ranks[pair] = pairs.rank(symbols[pair], symbols[pair + 1])
    return symbols


def encode_words(ranks: Ranks, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words that lie one after the other in `data`, and the number of ids of each."""
    sizes = np.diff(ends, prepend=0)
    starts, text = ends - sizes, data.tobytes()
    whole = [ranks.of.get(text[a:b], -1) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    whole = np.array(whole, np.int32)
    counts = np.where(whole >= 0, 1, 0).astype(np.int64)
    found, owners = [whole[whole >= 0]], [np.flatnonzero(whole >= 0)]
    rest = np.flatnonzero(whole < 0)
    for narrow, wide in zip((0, *WIDTHS), WIDTHS, strict=False):
        own = rest[(sizes[rest] > narrow) & (sizes[rest] <= wide)]
        for at in range(0, len(own), ROWS):
            part = own[at : at + ROWS]
            column = np.arange(sizes[part].max())
            inside = column < sizes[part][:, None]
            index = np.minimum(starts[part][:, None] + column, len(data) - 1)
            symbols = np.where(inside, ranks.byte[data[index]], np.int32(-1))
            for rows, done in merge_rows(symbols, ranks.pairs):
                kept = done >= 0
                number = kept.sum(axis=1)
                counts[part[rows]] = number
                found.append(done[kept])
                owners.append(np.repeat(part[rows], number))
    for word in rest[sizes[rest] > LONG].tolist():
        ids = merge_long(ranks.byte[data[starts[word] : ends[word]]], ranks.pairs)
        counts[word] = len(ids)
        found.append(ids)
        owners.append(np.full(len(ids), word))
    order = np.argsort(np.concatenate(owners), kind="stable")
    return np.concatenate(found).astype(np.int32)[order], counts


class Encoder:
    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.memo = pieces.Memo(
            lambda data, ends: encode_words(self.ranks, data, ends), CACHE_ENTRIES, CACHED_LENGTH, np.dtype(np.int32)
        )

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, and where each text's begin, and the end."""
        data, bounds = words.text_bytes(column)
        start = pieces.byte_level(data, bounds)
        end = np.append(start[1:], len(data))
        ids, counts, at = [], [], 0
        while at < len(start):  # a long text's words go in shares too
            stop = max(at + 1, int(np.searchsorted(start, start[at] + SHARE_BYTES)))
            low, high = start[at], end[stop - 1]
            some, number = self.memo.encode(data[low:high], start[at:stop] - low, end[at:stop] - low)
            ids.append(some)
            counts.append(number)
            at = stop
        ids = np.concatenate([*ids, np.zeros(0, np.int32)])
        sums = np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))])
        return ids, sums[np.searchsorted(start, bounds)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each text's begin, and the end."""
        sums = np.concatenate([[0], np.cumsum(self.ranks.size[ids])])
        return self.ranks.decode(ids), sums[bounds]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(
    docs: DataFrame,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per document: doc_id, ids (tokens of the text), decoded (the bytes of these tokens), and the columns to keep."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in frames.slices(batches, limit=SHARE_BYTES):
            ids, bounds = own.encode(batch.column("text"))
            data, places = own.decode(ids, bounds)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
            offsets = pa.py_buffer(places.astype(np.int32).tobytes())
            decoded = pa.Array.from_buffers(pa.binary(), len(lists), [None, offsets, pa.py_buffer(data.tobytes())])
            others = [batch.column(f"_{c}") for c in keep]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, decoded, *others], names)

    rows = frames.texts(docs, id_col, text_col, **{f"_{c}": c for c in keep})
    names = ["doc_id", "ids", "decoded", *(f"_{c}" for c in keep)]
    kinds = dict(rows.dtypes)
    kept = "".join(f", `_{c}` {kinds[f'_{c}']}" for c in keep)
    out = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, ids array<int>, decoded binary{kept}")
    return out.withColumnsRenamed({f"_{c}": c for c in keep})


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each document's ids and of the bytes that they decode to."""
    return encode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
