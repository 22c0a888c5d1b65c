import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from cases import SPACE_WORD, by_id_and_text, lower, no_documents, odd_documents, ordered
from pyspark.sql import functions as F

from marketpulse.llm import components as stars
from marketpulse.llm import frames, jaccard
from marketpulse.llm.components import components


def shingles(text):
    words = SPACE_WORD.findall(lower(text))
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 3]) for k in range(len(words) - 2))


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def brute_force(rows):
    sets, union, having = [(i, shingles(t)) for i, t in rows], Union(), defaultdict(list)
    for k, (doc_id, own) in enumerate(sets):
        if doc_id is not None and own:
            common = defaultdict(int)
            for s in own:
                for j in having[s]:
                    common[j] += 1
                having[s].append(k)
            for j, n in common.items():
                if 100 * n >= 90 * (len(own) + len(sets[j][1]) - n):
                    union.join(doc_id, sets[j][0])
    return ordered((i, len(s), None if i is None else union.find(i) if s else i) for i, s in sets)


def near_copies(families=30, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 9, 11, 12, 20, 30, 60, 200, 400]))
        for _ in range(rng.randint(1, 12)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                at, kind = rng.randrange(len(words)), rng.random()
                if kind < 0.5:
                    words[at] = rng.choice(vocabulary)
                elif kind < 0.75:
                    words.insert(at, rng.choice(vocabulary))
                elif len(words) > 1:
                    words.pop(at)
            rows.append((3 * len(rows) + 1, " ".join(words) + (" " + passage if rng.random() < 0.2 else "")))
    rows += [(None, "a b c"), (5000, None), (5001, ""), (5003, "a b"), (5004, "A B"), (5005, "a b c")]
    return [*rows, (1, rows[50][1]), (1, "solo text here now"), (rows[4][0], rows[4][1])]


@pytest.mark.parametrize("tile", [jaccard.TILE_SHINGLES, 150])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", tile)  # the small one cuts clusters into bands and tiles
    rows = near_copies()
    got = jaccard.join(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string"))
    assert ordered(got.collect()) == brute_force(rows)


@pytest.mark.parametrize("share", [1, 8, 1 << 40])  # no key is hot, some are, all are
@pytest.mark.parametrize("documents", [0, 20])  # every shingle is hot, or the common ones
def test_hot_keys(spark, monkeypatch, share, documents):
    monkeypatch.setattr(frames, "HOT_SHARE", share)
    monkeypatch.setattr(frames, "EASY_ROWS", 0)
    monkeypatch.setattr(jaccard, "HOT_DOCUMENTS", documents)
    monkeypatch.setattr(jaccard, "HOT_TIMES", 0)
    rows = near_copies(families=12)
    rows += [(10_000 + k, rows[3][1]) for k in range(len(rows))]  # half of all documents are one class
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert ordered(got) == brute_force(rows)


def test_rows_of_a_hot_key_are_not_shuffled(spark, monkeypatch):
    rows = spark.range(9000).select((F.col("id") % 3 * 0).alias("k"), "id").union(spark.range(100, 200).selectExpr("id", "id"))
    table = rows.groupBy("k").agg(F.max("id").alias("most"), F.count("*").alias("rows"))
    monkeypatch.setattr(frames, "HOT_SHARE", 8)
    found = frames.join_counted(rows, table, ["k"], "rows", 9100)
    assert found.columns == ["k", "id", "most"]
    assert found.where("k = 0").count() == 9000 and found.where("k > 0 and most = k").count() == 100


def test_copies_of_a_task_are_posted_once():
    batch = pa.RecordBatch.from_pydict({"text": pa.array([" ".join(f"w{k}" for k in range(30))] * 5, pa.large_string())})
    levels, none = np.zeros(1 << jaccard.BUCKET_BITS, np.uint8), np.zeros(0, np.int64)
    found = [b.num_rows for b in jaccard._postings(levels, none, iter([batch, batch]), 3, 90)]
    assert found == [jaccard.prefix_size(28), 0]
    hot = np.arange(1 << jaccard.BUCKET_BITS)
    names = [r for b in jaccard._postings(levels, hot, iter([batch]), 3, 90) for r in b.to_pylist()]
    assert len(names) == 2 * jaccard.prefix_size(28) and {r["n"] for r in names} == {0}


def test_linked_sizes_are_in_neighbouring_bands():
    for percent in (80, 90):
        n = np.arange(9, 5000)
        least = -(-percent * n // 100)
        step = jaccard._bands(n, percent) - jaccard._bands(least, percent)
        assert step.max() <= 1


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert ordered(jaccard.join(docs).collect()) == brute_force(by_id_and_text(docs))


def test_odd_documents_and_empty_table(spark):
    docs = odd_documents(spark)
    assert ordered(jaccard.join(docs).collect()) == brute_force(by_id_and_text(docs))
    assert jaccard.join(no_documents(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    docs = odd_documents(spark)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "8", "None", "None"]


def test_different_texts_of_an_id_stay(spark):
    rows = [(1, "one text of its own", "b"), (1, "another text", "x"), (1, "one text of its own", "a"), (2, "Another Text", "y")]
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert ordered(kept.collect()) == ordered([rows[1], rows[2]])


def test_tree_passes_every_link():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    sets = []
    for _ in range(40):
        base = rng.choice(pool, int(rng.integers(9, 150)), replace=False)
        for _ in range(int(rng.integers(1, 8))):
            sets.append(np.unique(np.concatenate([base[: len(base) - int(rng.integers(0, 6))], rng.choice(pool, 2)])))
    union = Union()
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    roots = [union.find(k) for k in range(len(sets))]
    assert jaccard.connect(sets).tolist() == roots


def test_prefixes_of_linked_sets_meet():
    for n in range(1, 300):
        assert jaccard.prefix_size(n) == n - -(-90 * n // 100) + 1
    # a set below the smallest size cannot link with a different one
    assert all(100 * n < 90 * (n + 1) for n in range(1, jaccard.SMALLEST))


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000 + k, 1000) for k in range(50)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    labels = {r.node: r.label for r in found.collect()}
    assert len(labels) == found.count()
    assert all(label == (0 if node < 1000 else 1000) for node, label in labels.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("step", [1, 3, 7, 1000])
def test_groups_hold_every_pair_that_may_link(monkeypatch, step):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    rng = random.Random(4)
    rows = sorted((rng.randrange(12), rng.choice([20, 21, 22, 40, 41, 90, 100]), k) for k in range(150))
    batch = pa.RecordBatch.from_pydict(
        {"token": [r[0] for r in rows], "n": [r[1] for r in rows], "one": [r[2] for r in rows]}
    )
    batches = [batch.slice(k, step) for k in range(0, len(rows), step)]
    found = [r for b in jaccard._groups(iter(batches)) for r in b.to_pylist()]
    union, pairs = Union(), {frozenset((r["a"], r["b"])) for r in found if not r["sure"]}
    for r in found:
        union.join(r["a"], r["b"])
    sizes = {k: n for _, n, k in rows}
    assert all(100 * min(sizes[a], sizes[b]) >= 90 * max(sizes[a], sizes[b]) for a, b in map(tuple, pairs))
    for token, n, k in rows:
        for other, m, j in rows:
            if token == other and k != j and 100 * min(n, m) >= 90 * max(n, m):
                assert union.find(k) == union.find(j)
    assert any(r["sure"] for r in found) and pairs


def test_codes_of_counts_keep_their_order():
    rng = np.random.default_rng(1)
    counts = np.unique(np.concatenate([np.arange(10_000), rng.integers(0, 1 << 40, 10_000), 2 ** np.arange(41)]))
    codes = jaccard._codes(counts).astype(np.int64)
    greatest = jaccard._greatest(codes)
    assert (np.diff(codes) >= 0).all() and (codes[:4096] == np.arange(4096)).all()
    assert (greatest >= counts).all() and ((greatest - counts) * 2048 <= counts).all()


def test_levels_follow_counts_and_reach_the_driver_as_few_bytes(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(300)) for _ in range(60)]
    monkeypatch.setattr(jaccard, "HOT_DOCUMENTS", 9)
    monkeypatch.setattr(jaccard, "HOT_TIMES", 0)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    seen, fetch = [], type(frame).toArrow
    monkeypatch.setattr(type(frame), "toArrow", lambda self: seen.append(fetch(self)) or seen[-1])
    levels, hot = jaccard.bucket_levels(frame, 1)
    counts = np.zeros(1 << jaccard.BUCKET_BITS, np.int64)
    values, _ = jaccard.shingle_sets(pa.array(texts, pa.large_string()), 1)
    np.add.at(counts, jaccard._bucket(values), 1)
    order = np.argsort(counts, kind="stable")
    assert (np.diff(levels[order].astype(int)) >= 0).all() and len(np.unique(levels)) > 3
    assert hot.tolist() == np.flatnonzero(counts > 9).tolist() and len(hot)
    # a counter of 64 bits was 8 bytes and more
    assert sum(t.nbytes for t in seen) < 3 * jaccard.PACK * sum(t.num_rows for t in seen)


def test_stars_take_no_round(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(stars, "checkpointed", lambda frame: rounds.append(1) or frames.checkpointed(frame))
    edges = [(k % 3, 10 + k) for k in range(40)] + [(None, 4), (4, 4), (12, 2)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in found} == {k: k for k in range(3)} | {10 + k: k % 3 for k in range(40)}
    assert len(rounds) == 1


@pytest.mark.parametrize("easy", [0, 150, frames.EASY_ROWS])  # joins, then windows, windows only
def test_components_by_joins_and_windows(spark, monkeypatch, easy):
    monkeypatch.setattr(frames, "EASY_ROWS", easy)
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, 500 + k) for k in range(60)]
    edges += [(399 - k, 900 + k // 2) for k in range(8)] + [(None, 7), (450, 400)]
    union = Union()
    for a, b in edges:
        if a is not None and a != b:
            union.join(a, b)
    found = components(spark.createDataFrame([*edges, *edges], "a long, b long").repartition(5)).collect()
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert sorted((r.node, r.label) for r in found) == sorted((x, union.find(x)) for x in nodes)


def test_few_edges_take_two_shuffles_a_round(spark, monkeypatch):
    shuffles = []

    def checkpointed(frame):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        shuffles.append(sum("Exchange" in line for line in plan.splitlines()))
        return frames.checkpointed(frame)

    monkeypatch.setattr(stars, "checkpointed", checkpointed)
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r.label for r in components(edges).collect()} == {0}
    assert len(shuffles) > 2 and max(shuffles[1:]) <= 2


def test_copies_go_without_a_join_of_all_rows(spark, monkeypatch):
    rows = near_copies(families=12)
    labels = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = {r.doc_id for r in labels if r.doc_id is not None and r.doc_id == r.component_id}
    monkeypatch.setattr(frames, "join_counted", None)  # nothing is labelled row by row
    monkeypatch.setattr(jaccard, "_tiles", lambda members, percent: members.select("rep", "one", "two", F.array(F.xxhash64("cluster")).alias("tiles")))
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in got if r.doc_id is not None) == sorted(
        {(i, t or "") for i, t in rows if i in kept}
    )
    assert sum(r.doc_id is None for r in got) == 1
