"""Spelling variants: words that differ by one character, found through a variable-length gram index.

1. Tasks cut the texts into runs of letters, delete a character of one run in 199 as the query's contract says, and
   count words; the counts are added up over all documents.
2. A gram of a word (which is set between two marks) that more than LIMIT words hold is continued by one character;
   the gram dictionary holds these longer grams of up to LONGEST characters. It is a prefix tree whose frequent nodes
   alone have children, and no more than GRAMS of the most frequent are kept: a smaller dictionary gives longer
   lists, never another result, so it can be sent to every task.
3. A word is decomposed: from each character on, the longest gram of the dictionary, else SHORTEST characters. What
   the search read from there on are the characters that the choice depends on. One edit changes at most as many of
   the word's grams as choices depend on one place: the word's affected-gram bound.
4. Grams are ordered by how many words hold them, rarest first (by counters of a fixed number; any order will do that
   is the same for all words). Two near words share an unaffected gram; the first such gram has only affected ones
   before it, so it is among the first bound + 1 grams of both. Only these enter the lists.
5. An unaffected gram left of the edit has the same text before it in both words, one right of it the same text after
   it. So a gram's list is divided by side and that text, and the pairs of each part are verified by edit distance.

The form of a word is its near word of largest n; roots follow by doubling steps, of which five suffice, as n grows by
a factor of five with each form.

Nulls: a null text has no words; in a document with a null id no character is deleted. Repeated documents count each
time. An empty table gives no rows. Memory of a task follows `SLICE_BYTES` or the longest text, and the dictionary.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import frames, pieces, words

#: One run in DELETED loses a character; words have at least LETTERS characters and LEAST occurrences.
DELETED, LETTERS, LEAST = 199, 6, 5
#: A form occurs at least so many times as often.
RATIO = 5
#: Lengths of grams. With two marks a word has LETTERS + 1 grams or more, and an edit affects at most LONGEST of them.
SHORTEST, LONGEST = 2, 5
LIMIT = 200
GRAMS = 1 << 17
COUNTERS = 1 << 18
FIRST, LAST = "^", "$"

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_ALONE = 64  # longer runs get their crc32 one by one


# Words


def runs(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of LETTERS characters or more: starts, ends, numbers of characters, and the text of each.

    U+00C0 to U+00FF are exactly the characters of two bytes that begin with 0xC3.
    """
    wide = data == 0xC3
    inside = words.LETTERS[data] | wide
    inside[1:] |= wide[:-1]
    start, end, first = words.runs(inside, bounds)
    sums = np.concatenate([[0], np.cumsum(wide)])
    size = end - start - (sums[end] - sums[start])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    kept = size >= LETTERS
    return start[kept], end[kept], size[kept], text[kept]


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, register: np.ndarray) -> np.ndarray:
    """crc32 of spans, each continued from a register (the crc32 of what comes before it)."""
    order = np.argsort(start - end, kind="stable")
    first, size = start[order], (end - start)[order]
    state = register[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    alone = int(np.searchsorted(-size, -_ALONE, "left"))
    for k in range(int(size[alone]) if alone < len(size) else 0):
        active = slice(alone, int(np.searchsorted(-size, -k, "left")))
        now = state[active]
        state[active] = _CRC[(now ^ data[first[active] + k]) & 0xFF] ^ (now >> np.uint32(8))
    out = np.empty(len(start), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:alone].tolist():
        out[k] = zlib.crc32(data[start[k] : end[k]].tobytes(), int(register[k]))
    return out


def counted(ids: pa.Array, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of the texts and how often each occurs. `ids` are texts too."""
    raw, bounds = words.text_bytes(column)
    data = words.lowered(raw)
    start, end, size, text = runs(data, bounds)
    names = ids.to_pylist()
    register = np.array([zlib.crc32(f"{i}:".encode()) if i is not None else 0 for i in names], np.uint32)
    named = np.array([i is not None for i in names], bool)
    crc = checksums(data, start, end, register[text]) if len(start) else np.zeros(0, np.uint32)
    hit = (crc % DELETED == 0) & named[text]
    shortened: Counter[str] = Counter()
    for k in np.flatnonzero(hit).tolist():
        run, place = data[start[k] : end[k]].tobytes().decode(), int(crc[k]) % int(size[k])
        if size[k] > LETTERS:
            shortened[run[:place] + run[place + 1 :]] += 1
    start, end = start[~hit], end[~hit]
    _, sample, which, n = np.unique(words.span_hashes(data, start, end), return_index=True, return_inverse=True, return_counts=True)
    one = sample[which] if len(start) else sample
    same = (end - start == end[one] - start[one]).all()
    if not same or not np.array_equal(pieces.gather(data, start, end - start), pieces.gather(data, start[one], end[one] - start[one])):
        sample, n = np.arange(len(start)), np.ones(len(start), np.int64)  # words that share a hash: none is joined here
    lengths = (end - start)[sample]
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32).tobytes())
    found = pieces.gather(data, start[sample], lengths)
    column = pa.Array.from_buffers(pa.string(), len(sample), [None, offsets, pa.py_buffer(found.tobytes())])
    extra = pa.array(list(shortened), pa.string())
    return pa.concat_arrays([column, extra]), np.concatenate([n, np.fromiter(shortened.values(), np.int64)])


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: all words of the documents with at least LEAST occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames.slices(batches):
            found, n = counted(batch.column("doc_id"), batch.column("text"))
            yield pa.RecordBatch.from_arrays([found, pa.array(n, pa.int64())], ["word", "n"])

    rows = frames.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("string"))
    parts = rows.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


# Grams


def gram_counts(found: DataFrame) -> DataFrame:
    """gram, n: in how many places of the words each gram of SHORTEST to LONGEST characters stands."""
    marked = F.concat(F.lit(FIRST), "word", F.lit(LAST)).alias("p")
    grams = f"""explode(flatten(transform(sequence({SHORTEST}, {LONGEST}),
        q -> transform(sequence(1, length(p) - q + 1), i -> substring(p, i, q))))) AS gram"""
    return found.select(marked).selectExpr(grams).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def dictionary(grams: DataFrame) -> list[str]:
    """Grams that continue a frequent one: the most frequent, at most GRAMS."""
    frequent = grams.where((F.col("n") > LIMIT) & (F.length("gram") < LONGEST)).select(F.col("gram").alias("begin"))
    longer = grams.where(F.length("gram") > SHORTEST).withColumn("begin", F.expr("left(gram, length(gram) - 1)"))
    kept = longer.join(frequent, "begin", "left_semi").orderBy(F.desc("n"), "gram").limit(GRAMS)
    return [r.gram for r in kept.select("gram").collect()]


def rarity(grams: DataFrame) -> np.ndarray:
    """COUNTERS sums of gram counts, by the crc32 of the gram."""
    counter = F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(COUNTERS)).alias("at")
    rows = grams.groupBy(counter).agg(F.sum("n").alias("n")).collect()  # at most COUNTERS
    sums = np.zeros(COUNTERS, np.int64)
    for r in rows:
        sums[r["at"]] = r.n
    return sums


class Index:
    """Decomposes words by a gram dictionary."""

    def __init__(self, grams: list[str], sums: np.ndarray):
        self.grams = frozenset(grams)
        self.begins = frozenset(g[:k] for g in grams for k in range(SHORTEST, len(g)))
        self.sums = sums.tolist()
        self._ranks: dict[str, tuple[int, str]] = {}

    def _rank(self, gram: str) -> tuple[int, str]:
        if gram not in self._ranks:
            if len(self._ranks) > 4 * GRAMS:
                self._ranks.clear()
            self._ranks[gram] = self.sums[zlib.crc32(gram.encode()) % COUNTERS], gram
        return self._ranks[gram]

    def decompose(self, p: str) -> list[tuple[int, int, int]]:
        """For each place: start, end of the gram, and end of what the choice depends on (one more than all: the end)."""
        out, n, grams, begins = [], len(p), self.grams, self.begins
        for i in range(n - SHORTEST + 1):
            best = read = i + SHORTEST
            while p[i:read] in begins:
                read += 1
                if read > n:
                    break
                if p[i:read] in grams:
                    best = read
            out.append((i, best, read))
        return out

    def lists(self, word: str) -> list[str]:
        """The lists that a word enters: side and text up to, or from, each of its first grams."""
        p = f"{FIRST}{word}{LAST}"
        n, grams = len(p), self.decompose(p)
        change = [0] * (n + 2)
        for start, _, read in grams:
            change[start] += 1
            change[read] -= 1
        bound = depends = 0
        for k in range(n):  # an edit is at a character after the first mark
            depends += change[k]
            if k and depends > bound:
                bound = depends
        ranked = sorted(grams, key=lambda g: (self._rank(p[g[0] : g[1]]), g[0]))
        out = []
        for start, _, read in ranked[: bound + 1]:
            if read < n:
                out.append("<" + p[:read])
            if start:
                out.append(">" + p[start:])
        return out


def entries(found: DataFrame, grams: list[str], sums: np.ndarray) -> DataFrame:
    """entry, word, n: a row for each list that a word enters."""
    shared = found.sparkSession.sparkContext.broadcast((grams, sums))
    held: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Index(*shared.value))
        for batch in batches:
            lists = [held[0].lists(w) for w in batch.column("word").to_pylist()]
            sizes = np.array([len(x) for x in lists], np.int64)
            which = pa.array(np.repeat(np.arange(len(lists)), sizes))
            keys = pa.array([x for one in lists for x in one], pa.string())
            columns = [keys, batch.column("word").take(which), batch.column("n").take(which)]
            yield pa.RecordBatch.from_arrays(columns, ["entry", "word", "n"])

    return found.select("word", "n").mapInArrow(run, "entry string, word string, n long")


def near(listed: DataFrame) -> DataFrame:
    """one, two, n_one, n_two: each pair of words at edit distance 1 once, one < two."""
    a = listed.select("entry", F.col("word").alias("one"), F.col("n").alias("n_one"))
    b = listed.select("entry", F.col("word").alias("two"), F.col("n").alias("n_two"))
    alike = (F.abs(F.length("one") - F.length("two")) <= 1) & (F.col("one") < F.col("two"))
    pairs = a.join(b, "entry").where(alike & (F.levenshtein("one", "two", 1) == 1))
    return pairs.select("one", "two", "n_one", "n_two").distinct()


# Groups


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words with a form (word, form): the last word that forms lead to."""
    at = frames.checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = at.join(step, "root", "left")
        doubled = moved.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        doubled = frames.checkpointed(doubled)
        at = doubled.select("word", "root")
        if not doubled.where("moved").head(1):
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    frames.ship(docs.sparkSession)
    found = frames.checkpointed(word_counts(docs, id_col, text_col))
    grams = frames.checkpointed(gram_counts(found))
    pairs = frames.checkpointed(near(entries(found, dictionary(grams), rarity(grams))))
    both = pairs.select(F.col("one").alias("word"), F.col("two").alias("other"), F.col("n_two").alias("n_other")).unionByName(
        pairs.select(F.col("two").alias("word"), F.col("one").alias("other"), F.col("n_one").alias("n_other"))
    )
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("n"), "other")).alias("best")
    )
    joined = found.join(best, "word", "left")
    enough = -F.col("best.n") >= RATIO * F.col("n")
    rows = frames.checkpointed(
        joined.select(
            "word",
            F.when(enough, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(enough, -F.col("best.n")).alias("form_n"),
        )
    )
    return rows.join(roots(rows.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
