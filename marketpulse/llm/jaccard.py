"""N-gram Jaccard join by signature trees: documents whose shingle sets have a Jaccard index of at least `percent`.

Shingles have `width` words. op8's values, WORDS and LEAST, are the defaults; figures below are theirs.

1. Shingle sets are hashed (64 bits a shingle; the hashes' sums, 128 bits, name a set). Documents with equal sets form
   a class; from here on a class is one item, however many copies it has. A set of fewer than 9 shingles cannot
   reach 90 percent with any other set.
2. Shingles are put in one order for the whole corpus: by how often their hash bucket occurs in all documents, rare
   ones first. Two sets that link share one of their first n - ceil(0.9 n) + 1 shingles. Sets that share one, and
   whose sizes allow a link, are a group. Pairs of a group of at most GROUP sets are dropped if the parities of their
   hashes (n / 2 bits or more) differ in more places than linked sets can; a larger group stays together. The sets of a
   shingle whose bucket is hot never meet in a task: each is put with a name that stands for the shingle and a band of
   sizes, its own and the next one, so that sets whose sizes allow a link share a name. What is connected then is a
   cluster, and no possible link crosses clusters.
3. A cluster's sets meet in one task if they hold at most TILE_SHINGLES together. Larger ones are cut into bands of
   size, which only neighbours can link across, and large bands into parts; a task gets one pair of parts.
4. A task builds a signature tree of its sets: leaves in order of size, nodes with the OR of their token bitmaps, the
   range of sizes, and how many tokens at most share a bit with another of their set. The tree is joined with itself
   from the top; a pair of nodes goes when sizes, or the greatest possible overlap (common bits and shared bits),
   rule out a link. Pairs of leaves are verified on the hashes themselves, unless other links connect them already:
   what counts is which sets are connected, and a task returns at most one link for each of its sets.
5. Links of all tasks are joined into components.

Texts are shuffled once, to meet the clusters they are in; memory of a task follows two tiles or the longest text.
Classes that hold a large part of all rows are joined by broadcast (`frames.join_counted`), clusters and nodes of
links too where there are more than `frames.EASY_ROWS`; bands are met by a salt.

Nulls: a null text has no words; a row without an id has no component and links with nothing. Rows that share an id
are one document: it has the links of all of them. Documents without words are linked with nothing, not with each
other either. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import frames, words
from marketpulse.llm.components import components

#: Words of a shingle and least percent of op8.
WORDS = 3
LEAST = 90


def smallest(percent: int) -> int:
    """Sets below this size link with no other: one shingle more or less is too much."""
    return -(-percent // (100 - percent))


SMALLEST = smallest(LEAST)
#: Counters of shingles: a fixed number, so that they can be broadcast.
BUCKET_BITS = 22
PACK = 64
#: A bucket is hot if more documents than this have it, and more than HOT_TIMES the mean of all buckets.
HOT_DOCUMENTS = 1 << 16
HOT_TIMES = 8
#: Names of sets that a task remembers, so that copies are posted once.
SEEN = 1 << 18
SALTS = 16
TILE_SHINGLES = 2 << 20
FAN = 8
GROUP = 32
PAIRS_AT_ONCE = 1 << 15
EXACT_BYTES = 64 << 20


def shingle_sets(column: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin."""
    found = words.split(column, words.NOT_SPACE, lower=True)
    hashes, doc, counts = words.span_hashes(found.data, found.start, found.end), found.doc, found.counts
    inside = words.gram_inside(doc, width)
    owner, values = doc[: len(inside)][inside], words.gram_hashes(hashes, width)[inside]
    for n in range(1, width):  # a text of fewer words is one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            owner = np.concatenate([owner, short])
            values = np.concatenate([values, words.gram_hashes(hashes, n)[found.first[short]] ^ np.uint64(n)])
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    kept = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], kept[bounds]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def set_names(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set."""
    size = np.diff(bounds).astype(np.uint64)
    one = words.mix(_sums(values, bounds) + size)
    two = words.mix(_sums(words.mix(values ^ np.uint64(0x5DEECE66D)), bounds) ^ size)
    return one.view(np.int64), two.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in frames.slices(batches):
        values, bounds = shingle_sets(batch.column("text"), width)
        one, two = set_names(values, bounds)
        parity = pa.array(_parities(values, bounds, percent), pa.list_(pa.int64()))
        columns = [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(one), pa.array(two), parity]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "one", "two", "parity"])


def _bucket(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


_PACKED = [f"n{k}" for k in range(PACK)]


def _bucket_counts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A task's counts, PACK buckets a row: small numbers side by side take little room in a shuffle."""
    counts = np.zeros(1 << BUCKET_BITS, np.uint32)  # of the documents of one task
    for batch in frames.slices(batches):
        values, _ = shingle_sets(batch.column("text"), width)
        np.add.at(counts, _bucket(values), np.uint32(1))
    packed = counts.reshape(-1, PACK)
    some = np.flatnonzero(packed.any(axis=1))
    for k in range(0, len(some), 4096):
        part = some[k : k + 4096]
        columns = [pa.array(part), *(pa.array(c) for c in packed[part].T.astype(np.int64, order="C"))]
        yield pa.RecordBatch.from_arrays(columns, ["row", *_PACKED])


def _codes(counts: np.ndarray) -> np.ndarray:
    """Counts as numbers of 16 bits in the same order: exact below 4,096, to one in 2,048 above."""
    shift = np.maximum(np.frexp(counts.astype(np.float64))[1] - 12, 0)
    return np.minimum((shift << 11) + (counts >> shift), (1 << 16) - 1).astype("<u2")


def _greatest(codes: np.ndarray) -> np.ndarray:
    """The greatest count of each code."""
    codes = codes.astype(np.int64)
    shift = np.maximum((codes >> 11) - 1, 0)
    return ((codes - (shift << 11) + 1) << shift) - 1


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.stack([batch.column(name).to_numpy() for name in _PACKED], axis=1)
        codes = [c.tobytes() for c in _codes(counts)]
        columns = [batch.column("row"), pa.array(counts.sum(axis=1)), pa.array(codes, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "total", "codes"])


def bucket_levels(text: DataFrame, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket its place among all that occur in the order of their counts, in 256 steps; and the hot buckets.

    Counters are summed and cut to 16 bits by tasks: the driver gets 2 bytes of each. Equal counts have one place.
    """
    schema = ", ".join(f"{name} long" for name in ["row", *_PACKED])
    sums = [F.sum(name).alias(name) for name in _PACKED]
    counted = text.mapInArrow(lambda batches: _bucket_counts(batches, width), schema).groupBy("row").agg(*sums)
    counted = counted.mapInArrow(_coded, "row long, total long, codes binary").toArrow()
    codes = np.zeros(((1 << BUCKET_BITS) // PACK, PACK), "<u2")
    total = 0
    for batch in counted.to_batches():
        if batch.num_rows:
            found = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<u2")
            codes[batch.column("row").to_numpy()] = found.reshape(-1, PACK)
            total += int(batch.column("total").to_numpy().sum())
    del counted
    codes = codes.ravel()
    held = np.zeros(1 << 16, np.int64)
    for row in codes.reshape(64, -1):
        held += np.bincount(row, minlength=1 << 16)
    held[0] = 0
    place = (np.cumsum(held) - held) * 256 // max(1, int(held.sum()))
    often = _greatest(np.arange(1 << 16)) > max(HOT_DOCUMENTS, HOT_TIMES * total // codes.size)
    levels, hot = np.empty(codes.size, np.uint8), [np.zeros(0, np.int64)]
    for k in range(0, codes.size, 1 << 16):  # numpy makes 8 bytes of an index
        part = codes[k : k + (1 << 16)]
        levels[k : k + (1 << 16)] = place[part]
        hot.append(k + np.flatnonzero(often[part]))
    return levels, np.concatenate(hot)


def _bands(n: np.ndarray, percent: int) -> np.ndarray:
    """Bands of size: sets that link are in one or in neighbours."""
    return np.floor(np.log(n) / np.log(100 / percent)).astype(np.uint64)


def prefix_size(n: int, percent: int = LEAST) -> int:
    return n - -(-percent * n // 100) + 1


def _postings(
    levels: np.ndarray, hot: np.ndarray, batches: Iterator[pa.RecordBatch], width: int, percent: int
) -> Iterator[pa.RecordBatch]:
    """The first shingles of each set, in the order of the corpus; a set of several texts of a task once.

    A hot shingle gives two rows of size 0 instead, whose token is a name for the shingle and a band of sizes.
    """
    often = np.zeros(1 << BUCKET_BITS, bool)
    often[hot] = True
    seen: set[int] = set()
    for batch in frames.slices(batches):
        values, bounds = shingle_sets(batch.column("text"), width)
        one, _ = set_names(values, bounds)
        bucket, tokens, owners = _bucket(values), [np.zeros(0, np.uint64)], []
        level = levels[bucket]
        _, unique = np.unique(one, return_index=True)
        for k in unique.tolist():
            a, b = int(bounds[k]), int(bounds[k + 1])
            if b - a >= smallest(percent) and int(one[k]) not in seen:
                seen.add(int(one[k]))
                first = np.argsort(level[a:b], kind="stable")[: prefix_size(b - a, percent)]  # ties by hash
                tokens.append(values[a + first])
                owners += [k] * len(first)
        if len(seen) > SEEN:
            seen.clear()
        at, token = np.array(owners, np.int64), np.concatenate(tokens)
        size = np.diff(bounds)[at].astype(np.int32)
        hub = often[_bucket(token)]
        band = _bands(size[hub], percent)
        names = [words.mix(token[hub] ^ words.mix(band + np.uint64(k))) for k in (1, 2)]
        token = np.concatenate([token[~hub], *names]).view(np.int64)
        own = np.concatenate([one[at[~hub]], *[one[at[hub]]] * 2])
        size = np.concatenate([size[~hub], np.zeros(2 * len(band), np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(own), pa.array(size)], ["token", "one", "n"])


def _groups(batches: Iterator[pa.RecordBatch], percent: int = LEAST) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of token and size; sets that follow each other and whose sizes allow a link are a group.

    A group of at most GROUP sets gives all pairs whose sizes allow a link; a larger one links each set with its
    first, for sure, as its pairs would be too many. Rows of size 0 are such links themselves.
    """
    held, large = None, False  # the rows of the last group so far; of a large one, the first

    def pairs(one: np.ndarray, n: np.ndarray, start: np.ndarray, size: np.ndarray, sure: np.ndarray):
        many = sure & (np.arange(len(one)) != start)
        a, b = [one[start[many]]], [one[many]]
        at = np.flatnonzero(~sure & (size > 1))
        for d in range(1, GROUP):
            at = at[at + d < start[at] + size[at]]
            if not len(at):
                break
            near = at[100 * n[at] >= percent * n[at + d]]
            a.append(one[near])
            b.append(one[near + d])
        flags = np.concatenate([np.ones(len(a[0]), bool), np.zeros(sum(map(len, a[1:])), bool)])
        rows = np.stack([np.concatenate(a), np.concatenate(b), flags.astype(np.int64)], axis=1)
        rows = np.unique(rows[rows[:, 0] != rows[:, 1]], axis=0)
        columns = [pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2] == 1)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "sure"])

    def split(token: np.ndarray, one: np.ndarray, n: np.ndarray, last: bool):
        nonlocal held, large
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(token)))
        start, size = np.repeat(begin, count), np.repeat(count, count)
        sure = size > GROUP
        if large:
            sure[: count[0]] = True
        tail = int(begin[-1])
        if last:
            return pairs(one, n, start, size, sure)
        large = bool(count[-1] > GROUP or (large and tail == 0))
        # the last group may go on: of a large one the links so far are made, and its first row and last size stay
        done = len(token) if large else tail
        out = pairs(one[:done], n[:done], start[:done], size[:done], sure[:done])
        keep = [tail, len(token) - 1] if large and len(token) - 1 > tail else range(tail, len(token))
        held = tuple(x[list(keep)] for x in (token, one, n))
        return out

    for batch in batches:
        if batch.num_rows:
            rows = [batch.column(c).to_numpy().astype(np.int64) for c in ("token", "one", "n")]
            hub = rows[2] == 0
            if hub.any():
                sure = pa.array(np.ones(int(hub.sum()), bool))
                yield pa.RecordBatch.from_arrays([pa.array(rows[0][hub]), pa.array(rows[1][hub]), sure], ["a", "b", "sure"])
                rows = [x[~hub] for x in rows]
                if not len(rows[0]):
                    continue
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                # the size of a large group's first row must not end it
                if large and len(held[0]) == 2:
                    rows[2][0] = rows[2][1]
            yield split(*rows, last=False)
    if held is not None:
        yield split(*held, last=True)


def _parities(values: np.ndarray, bounds: np.ndarray, percent: int) -> list[list[int] | None]:
    """For each set, for each of at least n / 2 bits, whether an odd number of its hashes has it."""
    out: list[list[int] | None] = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a < smallest(percent):
            out.append(None)
            continue
        bits = max(256, 1 << ((b - a) // 2 - 1).bit_length())
        odd = np.bincount((values[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist())
    return out


def _folded(bits: Column, other: Column) -> Column:
    """Parities of half as many bits, where the other set has half as many."""
    half = F.size(other)
    both = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > half, both).otherwise(bits)


def _may_link(pairs: DataFrame, described: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that can link: sets that differ in parity differ in a hash, and linked sets in few."""
    kept = described.where(F.col("n_shingles") >= smallest(percent)).groupBy("one")
    kept = kept.agg(F.first("n_shingles").alias("n"), F.first("parity").alias("bits"))
    for side in ("a", "b"):
        own = kept.select(F.col("one").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}"))
        pairs = pairs.join(own, side)
    x, y = F.col("bits_a"), F.col("bits_b")
    differ = F.zip_with(_folded(x, y), _folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    total = F.aggregate(differ, F.lit(0), lambda n, d: n + d)
    most = F.col("n_a") + F.col("n_b")
    # |A xor B| = |A| + |B| - 2 |A and B|, and 100 |A and B| >= percent |A or B|
    return pairs.where((100 + percent) * total <= (100 - percent) * most).select("a", "b")


class SignatureTree:
    """Levels of nodes, leaves first; a node has FAN children that follow each other."""

    def __init__(self, sets: list[np.ndarray], bits: int, percent: int = LEAST):
        self.percent = percent
        size = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        bit = (np.concatenate(sets) % np.uint64(bits)).astype(np.int64)
        flags = np.zeros((len(sets), bits // 8), np.uint8)
        np.bitwise_or.at(flags, (owner, bit >> 3), (1 << (bit & 7)).astype(np.uint8))
        maps = flags.view(np.uint64)
        shared = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, shared)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, shared = self.levels[-1]
            at = np.arange(0, len(maps), FAN)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, at, axis=0),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(shared, at),
                )
            )

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets below nodes a and b can link, by their sizes and by the overlap that their bits allow."""
        maps, low, high, shared = self.levels[level]
        smaller, larger = np.minimum(high[a], high[b]), np.maximum(low[a], low[b])
        good = 100 * smaller >= self.percent * larger
        need = -(-self.percent * (low[a] + low[b]) // (100 + self.percent))
        at = np.flatnonzero(good)
        for k in range(0, len(at), PAIRS_AT_ONCE):
            part = at[k : k + PAIRS_AT_ONCE]
            common = np.bitwise_count(maps[a[part]] & maps[b[part]]).sum(axis=1, dtype=np.int64)
            good[part] = common + np.minimum(shared[a[part]], shared[b[part]]) >= need[part]
        return good

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves (a before b) that may link, some at a time: a descent of both sides of the tree together."""
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if len(a) > PAIRS_AT_ONCE:
                todo += [(level, a[k : k + PAIRS_AT_ONCE], b[k : k + PAIRS_AT_ONCE]) for k in range(0, len(a), PAIRS_AT_ONCE)]
                continue
            keep = self._possible(level, a, b)
            if level == 0:
                keep &= a != b
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            below = len(self.levels[level - 1][0])
            x = np.repeat(a * FAN, FAN * FAN) + np.tile(np.repeat(np.arange(FAN), FAN), len(a))
            y = np.repeat(b * FAN, FAN * FAN) + np.tile(np.tile(np.arange(FAN), FAN), len(b))
            keep = (x < below) & (y < below) & (x <= y)
            todo.append((level - 1, x[keep], y[keep]))


def _overlaps(sets: list[np.ndarray]):
    """A function that counts the common hashes of pairs of sets: on bitmaps over the hashes that several sets have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    ranked, owner = values[order], owner[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    several = ~(new & np.concatenate([new[1:], [True]]))
    number = np.cumsum(new & several)[several] - 1
    width = -(-(int(number[-1]) + 1 if len(number) else 1) // 64) * 64
    if len(sets) * width // 8 > EXACT_BYTES:

        def one(a: int, b: int) -> int:
            x, y = sets[a], sets[b]
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            return int(np.count_nonzero(y[at] == x))

        return lambda a, b: np.array([one(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    flags = np.zeros((len(sets), width // 8), np.uint8)
    np.bitwise_or.at(flags, (owner[several], number >> 3), (1 << (number & 7)).astype(np.uint8))
    maps = flags.view(np.uint64)
    step = max(1, (32 << 20) // (maps.shape[1] * 8))

    def count(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        parts = [
            np.bitwise_count(maps[a[k : k + step]] & maps[b[k : k + step]]).sum(axis=1, dtype=np.int64)
            for k in range(0, len(a), step)
        ]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    return count


def connect(sets: list[np.ndarray], percent: int = LEAST) -> np.ndarray:
    """For each set, the number of the first set that links connect it with."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort(([int(s[0]) for s in sets], size))
    ranked = [sets[k] for k in order.tolist()]
    ranked_size = size[order]
    bits = 1 << int(min(max(9, int(2 * size.max() - 1).bit_length()), 13))
    label = np.arange(len(sets))
    overlaps = _overlaps(ranked)
    for a, b in SignatureTree(ranked, bits, percent).pairs():
        for k in range(0, len(a), 1024):
            x, y = a[k : k + 1024], b[k : k + 1024]
            apart = label[x] != label[y]
            x, y = x[apart], y[apart]
            both = overlaps(x, y)
            linked = 100 * both >= percent * (ranked_size[x] + ranked_size[y] - both)
            for u, v in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
                p, q = int(label[u]), int(label[v])
                if p != q:
                    label[label == max(p, q)] = min(p, q)
    first = np.full(len(sets), len(sets))
    np.minimum.at(first, label, order)
    out = np.empty(len(sets), np.int64)
    out[order] = first[label]
    return out


def _links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (tile, rep, found) come in the order of tile; each tile is joined when its last row has come."""
    held, tile = [], None

    def join() -> pa.RecordBatch:
        reps, sets = zip(*dict(held).items(), strict=True)
        first = connect([np.frombuffer(s, "<u8") for s in sets], percent)
        at = np.flatnonzero(first != np.arange(len(first)))
        rep = np.array(reps, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(rep[first[at]]), pa.array(rep[at])], ["a", "b"])

    for batch in batches:
        for name, rep, found in zip(*(batch.column(c).to_pylist() for c in ("tile", "rep", "found")), strict=True):
            if name != tile and held:
                yield join()
                held = []
            tile = name
            held.append((rep, found))
    if held:
        yield join()


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """Rows (rep, one, two, tiles) of sets in clusters; sets that can link have a tile in common."""
    totals = members.groupBy("cluster").agg(F.sum("n").alias("total"), F.count("*").alias("sets"))
    count, most = totals.agg(F.sum("sets"), F.max("total")).first()
    totals = totals.where(F.col("sets") > 1)
    members = frames.join_counted(members, totals, ["cluster"], "sets", count or 0, frames.EASY_ROWS)
    small = F.col("total") <= TILE_SHINGLES
    whole = members.where(small).select("rep", "one", "two", F.array(F.xxhash64("cluster")).alias("tiles"))
    if (most or 0) <= TILE_SHINGLES:
        return whole

    # Sets of a band meet those of the same and of the next lower one; a band of many parts, part by part.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))
    large = members.where(~small).withColumn("band", F.explode(F.array(band, band + 1)))
    parts = F.ceil(F.sum("n") / F.lit(TILE_SHINGLES)).cast("int")
    bands = large.groupBy("cluster", "band").agg(parts.alias("parts"), F.count("*").alias("held"))
    # a band may hold most sets: they are dealt by a salt, and the bands, few beside them, are repeated for each
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    bands = bands.where(F.col("held") > 1).select("cluster", "band", "parts", salts)
    large = large.withColumn("salt", F.pmod(F.xxhash64("two"), F.lit(SALTS)).cast("int"))
    large = large.join(bands, ["cluster", "band", "salt"]).drop("salt")
    large = large.withColumn("own", F.pmod(F.xxhash64("one", "two"), F.col("parts")).cast("int"))

    def tile(k: Column) -> Column:
        return F.xxhash64("cluster", "band", F.least("own", k), F.greatest("own", k))

    large = large.withColumn("tiles", F.transform(F.sequence(F.lit(0), F.col("parts") - 1), tile))
    large = large.groupBy("rep", "one", "two").agg(F.flatten(F.collect_list("tiles")).alias("tiles"))
    return whole.union(large)


def _clustered_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Sets of the texts, for rows whose text has the set that its class is named after."""
    for batch in frames.slices(batches):
        values, bounds = shingle_sets(batch.column("text"), width)
        one, two = set_names(values, bounds)
        same = (one == batch.column("one").to_numpy()) & (two == batch.column("two").to_numpy())
        values = values.astype("<u8")
        lists = [values[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        out = pa.RecordBatch.from_arrays(
            [batch.column("rep"), batch.column("tiles"), pa.array(lists, pa.binary())], ["rep", "tiles", "found"]
        )
        yield out.filter(pa.array(same))


def links(
    rows: DataFrame, described: DataFrame, classes: DataFrame, width: int = WORDS, percent: int = LEAST
) -> DataFrame:
    """Links (a, b) between smallest ids of classes, enough to connect every two sets that links connect."""
    spark = rows.sparkSession
    text = rows.select("text")
    # 2**BUCKET_BITS bytes, and at most 2**BUCKET_BITS / HOT_TIMES numbers
    levels = spark.sparkContext.broadcast(bucket_levels(text, width))

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _postings(*levels.value, batches, width, percent)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _groups(batches, percent)

    posted = text.mapInArrow(postings, "token long, one long, n int")
    place = F.when(F.col("n") == 0, F.col("one")).otherwise(F.col("token"))
    grouped = posted.repartition(place).sortWithinPartitions("token", "n", "one")
    near = frames.checkpointed(grouped.mapInArrow(groups, "a long, b long, sure boolean").distinct())
    pairs = near.where(~F.col("sure")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = near.where("sure").select("a", "b").union(_may_link(pairs, described, percent))
    clusters = components(near).select(F.col("node").alias("one"), F.col("label").alias("cluster"))

    members = classes.where(F.col("n") >= smallest(percent)).select("one", "two", "n", "rep").join(clusters, "one")
    tiles = _tiles(frames.checkpointed(members), percent)
    sets = rows.join(tiles, rows["doc_id"] == tiles["rep"]).select("rep", "one", "two", "tiles", "text")
    sets = sets.mapInArrow(
        lambda batches: _clustered_sets(batches, width), "rep long, tiles array<long>, found binary"
    )
    sets = sets.select(F.explode("tiles").alias("tile"), "rep", "found")
    sets = sets.repartition("tile").sortWithinPartitions("tile")
    return sets.mapInArrow(lambda batches: _links(batches, percent), "a long, b long")


def _labelled(
    docs: DataFrame, id_col: str, text_col: str, width: int, percent: int
) -> tuple[DataFrame, DataFrame, int]:
    """Rows with the names of their sets; classes of equal sets with their component_id; rows with an id and a set."""
    if width < 1 or not 60 <= percent < 100:  # parities of linked sets are folded once at most
        raise ValueError("a shingle has a word or more, and percent is from 60 to 99")
    rows = frames.texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    described = rows.mapInArrow(
        lambda batches: _describe(batches, width, percent),
        "doc_id long, n_shingles long, one long, two long, parity array<long>",
    )
    described = frames.checkpointed(described)
    named = described.where(F.col("doc_id").isNotNull())
    filled = named.where(F.col("n_shingles") > 0)
    classes = filled.groupBy("one", "two", F.col("n_shingles").alias("n"))
    classes = frames.checkpointed(classes.agg(F.min("doc_id").alias("rep"), F.count("*").alias("held")))
    # an id of several rows connects the classes that they are in, each of which has a smallest id of its own
    ends = [f(c).alias(f"{c}_{k}") for c in ("one", "two") for k, f in enumerate((F.min, F.max))]
    ids = filled.groupBy("doc_id").agg(F.count("*").alias("rows"), *ends)
    several = (F.col("one_0") < F.col("one_1")) | (F.col("two_0") < F.col("two_1"))
    total, repeated = ids.agg(F.sum("rows"), F.count_if(several)).first()
    linked = links(rows.where(F.col("doc_id").isNotNull()), named, classes, width, percent)
    if repeated:
        own = filled.join(ids.where(several).select("doc_id"), "doc_id", "left_semi").select("doc_id", "one", "two").distinct()
        shared = own.join(classes, ["one", "two"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
        linked = linked.union(shared)
    labels = components(linked)
    classes = classes.join(labels, classes["rep"] == labels["node"], "left")
    classes = classes.select("one", "two", F.coalesce("label", "rep").alias("component_id"), "held")
    return described, classes, total or 0


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = LEAST
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id that links lead to, itself included)."""
    described, classes, total = _labelled(docs, id_col, text_col, width, percent)
    named = described.where(F.col("doc_id").isNotNull())
    filled = named.where(F.col("n_shingles") > 0)
    # read three times below
    out = frames.join_counted(filled, frames.checkpointed(classes), ["one", "two"], "held", total)
    out = out.select("doc_id", "n_shingles", "component_id")
    empty = named.where(F.col("n_shingles") == 0).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    nameless = described.where(F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.lit(None).cast("long"))
    return out.union(empty).union(nameless)


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = LEAST
) -> DataFrame:
    """One document of each group, the one with the smallest id; rows without an id stay.

    Of several rows with that id each different text stays once, with the smallest other columns.
    """
    described, classes, _ = _labelled(docs, id_col, text_col, width, percent)
    # a component's id is that of one of its rows, so classes name all that stay; a row without words stands for itself
    empty = described.where(F.col("n_shingles") == 0).select(F.col("doc_id").alias("_kept"))
    kept = frames.checkpointed(classes.select(F.col("component_id").alias("_kept")).union(empty).distinct())
    own = docs.join(kept, docs[id_col].cast("long") == F.col("_kept"), "left_semi")
    columns = [text_col, *(c for c in docs.columns if c != text_col)]
    names = F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")
    least = own.groupBy(*names).agg(F.min(F.struct(*columns)).alias("_row"))
    least = least.select(*(F.col("_row")[c].alias(c) for c in docs.columns))
    return least.union(docs.where(F.col(id_col).isNull()))
