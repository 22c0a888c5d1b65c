"""Benchmark decontamination: each slice of a shard is indexed (FM-index) and the test phrases are searched in it.

Words of a slice become symbols: words of the test phrases get their own, all others one that no phrase has. Runs of
phrase words that are shorter than every phrase cannot hold one and are left out of the index. The rest is sorted by
its suffixes, which gives a Burrows-Wheeler transform; a wavelet tree answers ranks on it. Phrases are searched
backwards, all at once, one rank step per word; occurrences are located through sampled suffix positions, and the
spans of all occurrences are merged.

Memory of a task follows `SHARD_BYTES` (or the longest text) and the block of phrases. A block holds items of about
`BLOCK_BYTES`; more items than that are searched block by block over the same rows, with a checkpoint between. Removal by several
blocks marks the hits of all on one text, cuts them at once, and goes on with the documents that it cut.

Nulls: a null text, of either table, has no words; a document with a null id is kept, with its own row; items without
words have no phrases. Items with a null id hit like others and are removed; n_items counts all of them together as one,
and the list of ids has none of them. Repeated documents give a row each. An empty table of either kind gives
documents without hits, or no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import frames, words

WINDOW = 10
SAMPLE = 8
BLOCK_BYTES = 4 << 20

SHARD_BYTES = 4 << 20
#: Symbols of the index: the end of the text, breaks between runs, then the words.
END, BREAK, WORDS = 0, 1, 2
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def item_words(text: str | None) -> list[bytes]:
    lowered = (text or "").encode().translate(bytes(words._LOWER))
    return re.findall(rb"[0-9a-z\x80-\xff]+", lowered)


def _null_last(item: str | None) -> tuple[bool, str]:
    return item is None, item or ""


class Phrases:
    """Windows of the items: symbols of their words, and which items have which window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
        for item_id, text in items:
            found = item_words(text)
            size = min(window, len(found))
            for k in range(len(found) - size + 1 if size else 0):
                owners[tuple(found[k : k + size])].add(item_id)
        windows = sorted(owners)
        self.owners = [sorted(owners[w], key=_null_last) for w in windows]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        vocabulary = sorted({x for w in windows for x in w})
        ends = np.cumsum([len(x) for x in vocabulary], dtype=np.int64)
        joined = np.frombuffer(b"".join(vocabulary), np.uint8)
        hashes = words.span_hashes(joined, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        symbol = {vocabulary[k]: n + WORDS for n, k in enumerate(order.tolist())}
        self.symbols = np.zeros((len(windows), window), np.int64)
        for row, w in enumerate(windows):
            self.symbols[row, : len(w)] = [symbol[x] for x in w]

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of a text's words; 0 for words that no phrase has."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + WORDS, 0)


class WaveletTree:
    """Ranks of symbols: one level of bits after the other, each stably sorted by the bits above."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1
            sums = np.zeros(len(values) + 1, np.int64)
            np.cumsum(bit, out=sums[1:])
            self.ones.append(sums)
            self.zeros.append(len(values) - int(sums[-1]))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        low, high = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbols >> (self.bits - 1 - level)) & 1
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            high = np.where(bit == 1, zeros + ones[high], high - ones[high])
        return high - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in sorted order: ranks by 1, 2, 4, ... symbols until all differ."""
    n, reach = len(text), 1
    _, rank = np.unique(text, return_inverse=True)
    order = np.argsort(rank, kind="stable")
    while reach < n and int(rank[order[-1]]) < n - 1:
        following = np.zeros(n, np.int64)
        following[: n - reach] = rank[reach:] + 1
        keys = rank * (n + 1) + following
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]]))
        reach *= 2
    return order


class FmIndex:
    """Index of a symbol sequence that holds no END."""

    def __init__(self, text: np.ndarray, symbols: int):
        text = np.append(text, END)
        order = suffix_order(text)
        self.size = len(text)
        self.last = text[order - 1]  # the word before each sorted suffix
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.tree = WaveletTree(self.last, max(1, int(symbols - 1).bit_length()))
        self.sampled = np.where(order % SAMPLE == 0, order, -1)

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.before[symbols] + self.tree.rank(symbols, at)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases that occur, with the sorted suffixes that begin with them: from low to below high."""
        alive = np.arange(len(phrases))
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            take = alive[lengths[alive] > k]
            low[take] = self.step(phrases[take, k], low[take])
            high[take] = self.step(phrases[take, k], high[take])
            alive = alive[high[alive] > low[alive]]
        return alive, low[alive], high[alive]

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Positions in the text of sorted suffixes: walk back, word by word, to a sampled one."""
        out = np.zeros(len(places), np.int64)
        todo, row, steps = np.arange(len(places)), places, 0
        while len(todo):
            known = self.sampled[row]
            out[todo[known >= 0]] = known[known >= 0] + steps
            todo, row = todo[known < 0], row[known < 0]
            row = self.step(self.last[row], row)
            steps += 1
        return out


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of the sizes, one after the other."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size - start, size)


def hits(found: words.Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences: their window, their first word and the word after their last."""
    none = np.zeros(0, np.int64)
    if not len(phrases.lengths):
        return none, none, none
    symbols = phrases.encode(words.span_hashes(found.data, found.start, found.end))
    start, end, _ = words.runs(symbols > 0, found.first)
    keep = end - start >= int(phrases.lengths.min())
    start, size = start[keep], (end - start)[keep]
    if not len(start):
        return none, none, none
    place = spread(start, size + 1)  # of each symbol among the words; a break follows each run
    text = symbols[np.minimum(place, len(symbols) - 1)]
    text[np.cumsum(size + 1) - 1] = BREAK
    index = FmIndex(text, len(phrases.hashes) + WORDS)
    window, low, high = index.search(phrases.symbols, phrases.lengths)
    first = place[index.locate(spread(low, high - low))]
    window = np.repeat(window, high - low)
    return window, first, first + phrases.lengths[window]


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Phrases]:
    """The items' phrases, by blocks of about BLOCK_BYTES."""
    rows = frames.texts(items, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    parts = -(-total // BLOCK_BYTES)
    key = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(parts, 1)))  # a null id too has a hash
    for part in range(parts):
        block = rows.where(key == part) if parts > 1 else rows
        yield Phrases([(None if r.doc_id is None else str(r.doc_id), r.text) for r in block.select("doc_id", "text").collect()])


def _merge(old: list | None, new: np.ndarray) -> list[int]:
    return sorted({*(old or ()), *new.tolist()})


def _search(phrases: Phrases):
    """Adds a block's hits to a frame's rows: the words hit, the items found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, limit=SHARD_BYTES):
            found = words.split(batch.column("text"), words.ALPHANUMERIC, lower=True)
            window, first, end = hits(found, phrases)
            hit = words.covered(len(found.start), first, end)
            word = np.flatnonzero(hit)
            text_of = np.searchsorted(found.first, word, side="right") - 1
            at = np.searchsorted(text_of, np.arange(len(found.bounds)))
            items: dict[int, set[str | None]] = defaultdict(set)
            owner = np.searchsorted(found.first, first, side="right") - 1
            for row, w in np.unique(np.stack([owner, window], axis=1), axis=0).tolist():
                items[row].update(phrases.owners[w])
            old_words, old_items = batch.column("hit").to_pylist(), batch.column("items").to_pylist()
            word_lists, item_lists = [], []
            for row in range(batch.num_rows):
                own = word[at[row] : at[row + 1]] - found.first[row]
                word_lists.append(_merge(old_words[row], own))
                item_lists.append(sorted({*(old_items[row] or ()), *items.get(row, ())}, key=_null_last))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.array(found.counts, pa.int64()),
                    pa.array(word_lists, pa.list_(pa.int64())),
                    pa.array(item_lists, pa.list_(pa.string())),
                ],
                ["doc_id", "text", "n_words", "hit", "items"],
            )

    return run


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, text, n_words, hit (positions of words in occurrences), items (with occurring windows)."""
    rows = frames.texts(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, text string, n_words long, hit array<long>, items array<string>"
    empty = "cast(null as long) n_words", "cast(null as array<long>) hit", "cast(null as array<string>) items"
    rows = rows.selectExpr("doc_id", "text", *empty)
    parts = 0
    for phrases in blocks(items, item_id_col, item_text_col):
        rows = frames.checkpointed(rows) if parts else rows
        rows = rows.mapInArrow(_search(phrases), schema)
        parts += 1
    return rows if parts else rows.mapInArrow(_search(Phrases([])), schema)


def report(docs: DataFrame, items: DataFrame, **columns: str) -> DataFrame:
    """The digest of `search` for each document."""
    found = search(docs, items, **columns)
    n_hit = F.size("hit").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _without(text: str, found: words.Words, row: int, start: np.ndarray, stop: np.ndarray) -> str:
    """A row's text without runs of its words."""
    raw, base, kept, done = text.encode(), found.bounds[row], [], 0
    for a, b in zip(start, stop, strict=True):
        kept.append(raw[done : found.start[a] - base])
        done = found.end[b - 1] - base
    return b"".join([*kept, raw[done:]]).decode()


def cut(batch_texts: pa.Array, phrases: Phrases) -> list[str]:
    """Texts without the spans of merged occurrences, until none is left."""
    out = [t or "" for t in batch_texts.to_pylist()]
    rows = list(range(len(out)))
    while rows:
        found = words.split(pa.array([out[r] for r in rows], pa.large_string()), words.ALPHANUMERIC, lower=True)
        _, first, end = hits(found, phrases)
        inside = words.covered(len(found.start), first, end)
        start, stop, at = words.runs(inside, found.first)
        again = []
        for k, row in enumerate(rows):
            if at[k] < at[k + 1]:
                out[row] = _without(out[row], found, k, start[at[k] : at[k + 1]], stop[at[k] : at[k + 1]])
                again.append(row)
        rows = again
    return out


def _replace(batch: pa.RecordBatch, text_col: str, new: list[str]) -> pa.RecordBatch:
    """The batch with new texts; a text that was cut and has no word left goes, a null one stays."""
    old = batch.column(text_col)
    new = [None if t is None else n for t, n in zip(old.to_pylist(), new, strict=True)]
    stays = [t == n or bool(WORD.search(n)) for t, n in zip(old.to_pylist(), new, strict=True)]
    batch = batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(new, old.type))
    return batch.filter(pa.array(stays, pa.bool_()))


def _cut_by_one(phrases: Phrases, text_col: str):
    """Cuts a frame's texts by the only block there is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, text_col, SHARD_BYTES):
            yield _replace(batch, text_col, cut(batch.column(text_col), phrases))

    return run


def _mark(phrases: Phrases, text_col: str, hit_col: str):
    """Adds the words that a block hits to those that others hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, text_col, SHARD_BYTES):
            found = words.split(batch.column(text_col), words.ALPHANUMERIC, lower=True)
            _, first, end = hits(found, phrases)
            word = np.flatnonzero(words.covered(len(found.start), first, end))
            at = np.searchsorted(word, found.first)
            old = batch.column(hit_col).to_pylist()
            lists = [_merge(old[k], word[at[k] : at[k + 1]] - found.first[k]) for k in range(batch.num_rows)]
            lists = pa.array(lists, batch.schema.field(hit_col).type)
            yield batch.set_column(batch.schema.get_field_index(hit_col), hit_col, lists)

    return run


def _cut_marked(text_col: str, hit_col: str):
    """Cuts the marked words out of a frame's texts and takes the marks away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches, text_col, SHARD_BYTES):
            found = words.split(batch.column(text_col), words.ALPHANUMERIC, lower=True)
            inside = np.zeros(len(found.start), bool)
            for k, own in enumerate(batch.column(hit_col).to_pylist()):
                inside[found.first[k] + np.array(own, np.int64)] = True
            start, stop, at = words.runs(inside, found.first)
            new = [
                _without(t or "", found, k, start[at[k] : at[k + 1]], stop[at[k] : at[k + 1]])
                for k, t in enumerate(batch.column(text_col).to_pylist())
            ]
            none = pa.nulls(batch.num_rows, batch.schema.field(hit_col).type)
            batch = batch.set_column(batch.schema.get_field_index(hit_col), hit_col, none)
            yield _replace(batch, text_col, new)

    return run


def _cut_by_blocks(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    """Rounds over all blocks: each marks its hits on the same text, which is then cut once; until a round has no hit."""
    hit_col = "hit"
    while hit_col in docs.columns:
        hit_col += "_"
    todo, done = docs.withColumn(hit_col, F.lit(None).cast("array<long>")), None
    schema = todo.schema
    while True:
        for phrases in blocks(items, "item_id", "text"):
            todo = frames.checkpointed(todo.mapInArrow(_mark(phrases, text_col, hit_col), schema))
        clean = todo.where(F.size(hit_col) == 0).drop(hit_col)
        done = clean if done is None else done.union(clean)
        todo = frames.checkpointed(todo.where(F.size(hit_col) > 0).mapInArrow(_cut_marked(text_col, hit_col), schema))
        if todo.isEmpty():
            return done


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The documents without the spans that occur in the benchmark; a document that loses all its words goes.

    Columns stay as they are, but for the text and its length. The result does not depend on the blocks: one block
    cuts a text in a task until no window is left, several mark all their hits before a round's cut.
    """
    frames.ship(docs.sparkSession)
    first = list(islice(blocks(items, "item_id", "text"), 2))
    if len(first) > 1:
        cut_to = _cut_by_blocks(docs, items, text_col)
    else:
        cut_to = docs.mapInArrow(_cut_by_one(first[0], text_col), docs.schema) if first else docs
    if n_chars_col in docs.columns:
        length = F.char_length(text_col).cast(docs.schema[n_chars_col].dataType)
        cut_to = cut_to.withColumn(n_chars_col, F.coalesce(length, n_chars_col))
    return cut_to
