import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import by_id_and_text, lower, no_documents, odd_documents

from marketpulse.llm import variants

SMALL = "/root/testdata/sf0.001/documents.parquet"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k, c in enumerate(a) if c != b[k]), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def brute_counts(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(lower(text)):
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_force(rows):
    n = brute_counts(rows)
    by_hole = {}
    for w in n:
        for part in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            by_hole.setdefault(part, []).append(w)
    form, near = {}, {w: set() for w in n}
    for group in by_hole.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), None if form[w] is None else n[form[w]]))
    return out


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def test_equals_brute_force(spark):
    docs = spark.read.parquet(SMALL).select("doc_id", "text").union(odd_documents(spark).select("doc_id", "text"))
    out = variants.variants(docs.repartition(7))
    assert out.columns == COLUMNS
    rows = out.collect()
    assert {tuple(r) for r in rows} == brute_force(by_id_and_text(docs)) and len(rows) == len({r.word for r in rows})
    assert any(r.form for r in rows)


def test_chains_and_strange_runs(spark):
    """Forms of forms, ties, letters at the edges of the class, capitals beyond ASCII, long runs, deleted characters."""
    texts = ["abcdef " * 6000, "abcdeg " * 500 + "abcdxg " * 90, "abcyxg " * 10 + "abcyxz " * 5 + "Abcyxz2abcyxz", "zbcyxz " * 5]
    texts += ["Éclair éclair ÀÖØÿ×÷ " * 40, "ÀÖØÿ×÷x " * 6 + "¿abcdehĀ" * 7, "q" * 5000 + " " + "qr" * 60 + " ", "aaaaaa aaaaaaa " * 9]
    texts += [" ".join("qr" * 60 for _ in range(9)), "ab́cdefgh " * 9, None, "", "Ã" * 6 + " " + "Ã" * 7]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "abcdef " * 700), (1, texts[1])]
    rows += [(1000 + k, "spelling " * 2) for k in range(2000)]  # some ids lose a character of it
    docs = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "doc_id long, text string, word string, form string, n long")
    got = {tuple(r) for r in variants.variants(docs).collect()}
    assert got == brute_force(rows)
    by_word = {r[0]: r for r in got}
    assert by_word["abcyxg"][2] == "abcdef" and by_word["abcyxz"][2] == "abcyxz"
    assert variants.variants(no_documents(spark)).collect() == []
    assert variants.variants(docs.where("text IS NULL")).collect() == []


def test_checksums():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcé", k=rng.choice([6, 7, 9, 30, 64, 65, 300]))).encode() for _ in range(500)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    register = np.array([zlib.crc32(f"{k}:".encode()) for k in range(500)], np.uint32)
    got = variants.checksums(data, ends - [len(t) for t in texts], ends, register)
    assert got.tolist() == [zlib.crc32(f"{k}:".encode() + t) for k, t in enumerate(texts)]


@pytest.mark.parametrize(("limit", "longest", "kept"), [(0, 5, 1 << 17), (3, 5, 40), (1000, 3, 10)])
def test_near_words_share_a_list(monkeypatch, limit, longest, kept):
    """Every pair at distance 1 meets in a list, whatever the dictionary and the order of grams."""
    monkeypatch.setattr(variants, "LONGEST", longest)
    rng = random.Random(limit)
    found = {"".join(rng.choices("aab" if k % 2 else "abcdé", k=rng.randint(6, 9))) for k in range(1500)}
    counts = Counter(p[i : i + q] for p in (f"^{w}$" for w in found) for q in range(2, longest + 1) for i in range(len(p) - q + 1))
    grams = [g for g in counts if len(g) > 2 and counts[g[:-1]] > limit]
    rng.shuffle(grams)
    index = variants.Index(grams[:kept], np.array([rng.randint(0, 9) for _ in range(variants.COUNTERS)]))
    lists = {w: set(index.lists(w)) for w in found}
    words, pairs = sorted(found), 0
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_edit(a, b):
                pairs += 1
                assert lists[a] & lists[b], (a, b)
    assert pairs > 100


def test_words_of_one_hash(monkeypatch, spark):
    monkeypatch.setattr(variants.words, "span_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))
    import pyarrow as pa

    found, n = variants.counted(pa.array(["1", None]), pa.array(["abcdef bcdefg abcdef", "bcdefg"]))
    sums = Counter()
    for w, k in zip(found.to_pylist(), n.tolist(), strict=True):
        sums[w] += k
    assert sums == {"abcdef": 2, "bcdefg": 2}
