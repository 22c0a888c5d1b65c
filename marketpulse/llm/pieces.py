"""Cutting texts into words by character classes, and remembering what words were encoded to; all in numpy.

Texts lie one after the other in one array of UTF-8 bytes; words are spans of it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from unicodedata import category

import numpy as np
import regex
from tokenizers import pre_tokenizers

from marketpulse.llm import words

OTHER, LETTER, NUMBER, SPACE, MARK = range(5)

#: Characters that tokenizer rules take for white space. A fixed value.
SPACES = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))

Encode = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@cache
def classes() -> np.ndarray:
    """The class of every code point. Marks are not a class of the byte-level rule, for which they are other characters.

    Where this Python's and the regex module's Unicode versions differ, the tokenizers library decides.
    """
    kinds = {"L": LETTER, "N": NUMBER, "M": MARK}
    table = np.fromiter((kinds.get(category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    unknown = "".join(chr(c) for c in range(0x110000) if table[c] == OTHER and category(chr(c)) == "Cn")
    ask = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for m in regex.finditer(r"[\p{L}\p{N}]", unknown):  # a letter joins the letter before it, a number the number
        table[ord(m[0])] = {3: LETTER, 2: NUMBER}.get(len(ask(f"a{m[0]}1{m[0]}")), OTHER)
    for m in regex.finditer(r"\p{M}", unknown):
        table[ord(m[0])] = MARK
    table[[ord(c) for c in SPACES]] = SPACE
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of UTF-8 bytes, and the byte each one starts at (None: all are ASCII, so it is their number)."""
    if not len(data) or data.max() < 128:
        return data, None
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4"), np.flatnonzero((data & 0xC0) != 0x80)


def byte_level(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the words of a byte-level tokenizer start, in bytes, ascending.

    `bounds` are the starts of texts and the end. The rule is public_tokenizers.PATTERN: a contraction, or a run of
    letters, numbers or others with the blank before it, or white space up to the last one before something else.
    """
    points, at = code_points(data)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    kind[kind == MARK] = OTHER
    first = np.zeros(n + 1, bool)  # of a text; the end counts as one
    first[bounds if at is None else np.searchsorted(at, bounds)] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = SPACE, kind[:-1]
    space = kind == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = points[:-1] == 32
    start = (kind != before) & ~(blank_before & ~space)
    # Of several white spaces, the last one starts a word if something else follows in its text.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:]
    last &= ~first[1:]
    start |= last
    start |= (before == SPACE) & ~space & ~blank_before
    start[first[:n]] = True
    marks = np.flatnonzero(points == 39)
    if len(marks):
        opens = first[marks] | ((before[marks] != OTHER) & ~blank_before[marks])
        marks = marks[opens & (marks + 1 < n)]
        one = points[marks + 1]
        two = points[np.minimum(marks + 2, n - 1)]
        inside = ~first[marks + 1]
        short = inside & np.isin(one, [ord(c) for c in "stmd"])
        long = inside & (marks + 2 < n) & ~first[np.minimum(marks + 2, n)]
        long &= (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[marks[short | long]] = True
        start[marks[short | long] + 1] = False
        start[marks[long] + 2] = False
        after = np.concatenate([marks[short] + 2, marks[long] + 3])
        start[after[after < n]] = True
    found = np.flatnonzero(start)
    return found if at is None else at[found]


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The spans of the pool that begin at `start` and have `size` items, one after the other."""
    total = int(size.sum())
    if not total:
        return pool[:0]
    index = np.ones(total, np.int64)
    full = size > 0
    start, size = start[full], size[full]
    ends = np.cumsum(size)
    index[0] = start[0]
    index[ends[:-1]] = start[1:] - (start[:-1] + size[:-1] - 1)
    return pool[np.cumsum(index, out=index)]


def _offsets(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


class Store:
    """Words by ascending hash, with their bytes and what they were encoded to."""

    def __init__(self, kind: np.dtype):
        self.keys = np.zeros(0, np.uint64)
        self.place, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.data, self.ids = np.zeros(0, np.uint8), np.zeros(0, kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the keys whether it is here, and where."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, at

    def add(self, keys: np.ndarray, data: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Words with keys that are not here yet."""
        place, first = _offsets(size) + len(self.data), _offsets(count) + len(self.ids)
        self.data, self.ids = np.concatenate([self.data, data]), np.concatenate([self.ids, ids])
        order = np.argsort(every := np.concatenate([self.keys, keys]), kind="stable")
        self.keys = every[order]
        for name, new in (("place", place), ("size", size), ("first", first), ("count", count)):
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])


class Memo:
    """Encodes each distinct word once and remembers it, in two generations of up to `entries` words each.

    `encode(data, ends)` gives the ids of words that lie one after the other and the number of ids of each.
    Words are told apart by 64-bit hashes and then compared byte by byte, so what is remembered changes speed only.
    """

    def __init__(self, encode: Encode, entries: int, longest: int, kind: np.dtype):
        self._encode, self.entries, self.longest, self.kind = encode, entries, longest, kind
        self.young, self.old = Store(kind), Store(kind)

    def _known(self, store: Store, keys: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Which of the words the store has, and where."""
        found, at = store.find(keys)
        found &= store.size[at] == size if len(store.keys) else False
        rows = np.flatnonzero(found)
        if len(rows):
            same = gather(store.data, store.place[at[rows]], size[rows]) == gather(data, start[rows], size[rows])
            wrong = np.add.reduceat(~same, _offsets(size[rows])) > 0 if not same.all() else np.zeros(len(rows), bool)
            found[rows[wrong]] = False
        return np.flatnonzero(found), at

    def encode(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in their order, and the number of ids of each. No word is empty."""
        if not len(start):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        hashes = words.span_hashes(data, start, end)
        keys, sample, which = np.unique(hashes, return_index=True, return_inverse=True)
        size = end - start
        spans = gather(data, start[sample][which], size[sample][which])
        alike = (size == size[sample][which]).all() and np.array_equal(spans, gather(data, start, size))
        if not alike:  # two words of one hash: every word counts as a new one, and none is remembered
            ids, count = self._encode(gather(data, start, size), np.cumsum(size))
            return ids, count
        first, many = start[sample], size[sample]
        pool, place, count = [], np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        held, left = 0, np.ones(len(keys), bool)
        for store in (self.young, self.old):
            todo = np.flatnonzero(left)
            rows, at = self._known(store, keys[todo], data, first[todo], many[todo])
            place[todo[rows]], count[todo[rows]] = store.first[at[rows]] + held, store.count[at[rows]]
            left[todo[rows]] = False
            pool.append(store.ids)
            held += len(store.ids)
            if store is self.old:
                again = todo[rows]
        new = np.flatnonzero(left)
        if len(new):
            ids, sizes = self._encode(gather(data, first[new], many[new]), np.cumsum(many[new]))
            place[new], count[new] = _offsets(sizes) + held, sizes
            pool.append(ids)
        ids = np.concatenate(pool)
        out = gather(ids, place[which], count[which]), count[which]
        self._remember(np.concatenate([again, new]), keys, data, first, many, ids, place, count)
        return out

    def _remember(self, rows, keys, data, first, many, ids, place, count) -> None:
        rows = rows[many[rows] <= self.longest]
        rows = rows[~self.young.find(keys[rows])[0]]
        if len(rows):
            kept = gather(data, first[rows], many[rows]), many[rows], gather(ids, place[rows], count[rows]), count[rows]
            self.young.add(keys[rows], *kept)
        if len(self.young.keys) > self.entries:
            self.young, self.old = Store(self.kind), self.young
