"""BPE encoding and decoding with the vocabulary file of a public byte-level tokenizer.

A task cuts its texts into words by the tokenizer's rule and encodes all new distinct words together: an index maps
each pair of neighbouring symbols to all its positions; ranks are taken in ascending order, all positions of a rank
are merged at once, and the positions of the pairs that this makes join the lists of their ranks. (A merge makes a
symbol that only later ranks use, so ascending order over all words gives what the usual order gives for each word.)
Decoding gathers the bytes of the tokens.

A worker remembers words in two generations of `CACHE_ENTRIES` each, which changes speed only. The text of a special
token becomes that token, as the library's default has it.

Nulls: a null text is empty and has no tokens; a null id stays null. Repeated documents give a row each. Memory
follows `SHARE_BYTES` or the longest text.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import frames, pieces, words

CACHE_ENTRIES = 400_000
CACHED_LENGTH = 64
#: Bytes of text whose new words are encoded together.
SHARE_BYTES = 4 << 20

def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary file: printable bytes for themselves, then from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        ids: dict[str, int] = model["vocab"]
        characters = byte_characters()
        byte_of = {c: b for b, c in enumerate(characters)}
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_rule = re.compile(b"|".join(re.escape(t.encode()) for t in longest_first)) if self.special else None
        self.base = np.array([ids[c] for c in characters], np.int64)
        size = max([*ids.values(), *self.special.values()]) + 1
        tokens = [b""] * size
        for token, k in ids.items():
            tokens[k] = bytes(byte_of[c] for c in token)
        for token, k in self.special.items():
            tokens[k] = token.encode()
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = (self.left << 32) | self.right
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges where a pair has none."""
        none = len(self._keys)
        if not none:
            return np.zeros(len(left), np.int64)
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self._keys, keys), none - 1)
        return np.where(self._keys[at] == keys, self._order[at], none)


class PairIndex:
    """Symbols of many words, chained within each word, and for each rank the positions of its pair."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary):
        sizes = np.diff(ends, prepend=0)
        self.vocabulary = vocabulary
        self.ends = ends
        self.symbol = vocabulary.base[data]
        n = len(self.symbol)
        self.after, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.after[self.ends - 1] = -1
        self.before[self.ends - sizes] = -1
        self.alive = np.ones(n, bool)
        self.lists: dict[int, list[np.ndarray]] = defaultdict(list)
        self.active: list[int] = []
        self._add(np.flatnonzero(self.after >= 0))

    def _add(self, at: np.ndarray) -> None:
        ranks = self.vocabulary.rank(self.symbol[at], self.symbol[self.after[at]])
        known = ranks < len(self.vocabulary.merged)
        at, ranks = at[known], ranks[known]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            if rank not in self.lists:
                heappush(self.active, rank)
            self.lists[rank].append(part)

    def _merge(self, rank: int) -> None:
        v, parts = self.vocabulary, self.lists.pop(rank)
        left, right = v.left[rank], v.right[rank]
        at = parts[0]
        if len(parts) > 1:
            at = np.sort(np.concatenate(parts))
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        second = self.after[at]
        good = self.alive[at] & (self.symbol[at] == left) & (second >= 0) & (self.symbol[second] == right)
        at, second = at[good], second[good]
        if left == right and len(at) > 1:  # of a row of equal symbols, pairs are taken from its start
            linked = np.concatenate([[False], second[:-1] == at[1:]])
            place = np.arange(len(at))
            good = (place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0
            at, second = at[good], second[good]
        if not len(at):
            return
        third = self.after[second]
        self.symbol[at] = v.merged[rank]
        self.alive[second] = False
        self.after[at] = third
        follows = third >= 0
        self.before[third[follows]] = at[follows]
        first = self.before[at]
        at = np.sort(np.concatenate([first[first >= 0], at[follows]]))
        self._add(at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at)

    def encode(self) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, and the number of ids of each."""
        while self.active:
            self._merge(heappop(self.active))
        kept = np.flatnonzero(self.alive)
        return self.symbol[kept].astype(np.int32), np.diff(np.searchsorted(kept, self.ends), prepend=0)


class Encoder:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.memo = pieces.Memo(
            lambda data, ends: PairIndex(data, ends, self.vocabulary).encode(),
            CACHE_ENTRIES,
            CACHED_LENGTH,
            np.dtype(np.int32),
        )

    def _specials(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and ids of special tokens in the texts."""
        rule, found, text = self.vocabulary.special_rule, [], data.tobytes()
        if rule and rule.search(text):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                found += [(a + m.start(), a + m.end(), self.vocabulary.special[m[0].decode()]) for m in rule.finditer(text[a:b])]
        start, end, ids = np.array(found, np.int64).reshape(-1, 3).T
        return start, end, ids

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, and where each text's begin, and the end."""
        data, bounds = words.text_bytes(column)
        special, after, special_ids = self._specials(data, bounds)
        start = pieces.byte_level(data, np.union1d(bounds, np.union1d(special, after)))
        end = np.append(start[1:], len(data))
        if len(special):
            inside = np.searchsorted(special, start, "right") - 1
            plain = (inside < 0) | (start >= after[inside])
            start, end = start[plain], end[plain]
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(start):  # a long text's words go in shares too
            stop = max(at + 1, int(np.searchsorted(start, start[at] + SHARE_BYTES)))
            low, high = start[at], end[stop - 1]
            some, number = self.memo.encode(data[low:high], start[at:stop] - low, end[at:stop] - low)
            ids.append(some)
            counts.append(number)
            at = stop
        ids, sums = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        first = sums[np.searchsorted(start, bounds)]
        if len(special):
            ids = np.insert(ids, sums[np.searchsorted(start, special)], special_ids)
            first = first + np.searchsorted(special, bounds)
        return ids, first

    def decode_column(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each text's begin, and the end."""
        size = self.vocabulary.size[ids]
        return pieces.gather(self.vocabulary.data, self.vocabulary.place[ids], size), np.concatenate([[0], np.cumsum(size)])[bounds]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        ids, bounds = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_column(np.asarray(ids), np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")


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
    """Per document: doc_id, ids (tokens of the text), decoded (the text of these tokens), and the columns to keep."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in frames.slices(batches, limit=SHARE_BYTES):
            ids, bounds = own.encode_column(batch.column("text"))
            data, places = own.decode_column(ids, bounds)
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
    out = out.withColumn("decoded", F.col("decoded").cast("string"))
    return out.withColumnsRenamed({f"_{c}": c for c in keep})


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of each document's ids and of the text that they decode to."""
    return encode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
