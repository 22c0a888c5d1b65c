"""Words and their hashes in numpy, over the concatenated UTF-8 bytes of many texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from marketpulse.llm.frames import strings

_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)

#: Bytes that words consist of: `[^\x20\x09-\x0D]` and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`. UTF-8 bytes of
#: characters beyond ASCII are all word bytes in either rule, so bytes give the same words as characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the longest slice so far."""
    if not _powers or len(_powers[0]) < length:
        size = 1 << max(16, int(length - 1).bit_length())
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers[:] = tables
    return _powers[0], _powers[1]


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """data: the bytes; bounds: where each text starts, and the end; start, end: of words; first: each text's first word, and the end."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    column = strings(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return (_LOWER[raw] if lower else raw), bounds - bounds[0]


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross a bound: starts, ends, and the first run of each text."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, bounds)


def split(column: pa.Array, word_bytes: np.ndarray, lower: bool) -> Words:
    data, bounds = text_bytes(column, lower)
    return Words(data, bounds, *runs(word_bytes[data], bounds))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial with random coefficients for bytes, then mixed with the length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, at every word from which n follow in the whole array."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:size].copy()
    for k in range(1, n):
        out *= _BASE
        out += hashes[k : k + size]
        if k % 4 == 3:
            out ^= out >> np.uint64(31)
    return mix(out)


def gram_inside(doc: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from each position on belong to one text."""
    size = len(doc) - n + 1
    return doc[:size] == doc[n - 1 :] if size > 0 else np.zeros(0, bool)


def repeated(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its hash occurs twice or more in its text; whether it occurred earlier in it."""
    keys = hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    ranked = np.sort(keys)
    several = ranked[1:][ranked[1:] == ranked[:-1]]
    if len(several):
        at = np.minimum(np.searchsorted(several, keys), len(several) - 1)
        twice = several[at] == keys
        items = np.flatnonzero(twice)
        order = items[np.argsort(keys[items], kind="stable")]
        later[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return twice, later


def covered(length: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions that lie in any of the spans."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each text's items."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
