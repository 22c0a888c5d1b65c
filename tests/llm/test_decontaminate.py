import hashlib
import random

import numpy as np

from marketpulse.llm import decontaminate
from cases import PLAIN_WORD, by_id_and_text, lower, no_documents, odd_documents, odd_rows, ordered

ITEMS = "item_id long, text string, hit string"


def windows(items):
    out = {}
    for item_id, text in items:
        words = PLAIN_WORD.findall(lower(text))
        size = min(10, len(words))
        if size:
            for k in range(len(words) - size + 1):
                out.setdefault(tuple(words[k : k + size]), set()).add(None if item_id is None else str(item_id))
    return out


def expected(docs, items):
    known = windows(items)
    rows = []
    for doc_id, text in docs:
        words, hit, found = PLAIN_WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in known}:
            for k in range(len(words) - size + 1):
                owners = known.get(tuple(words[k : k + size]))
                if owners:
                    hit.update(range(k, k + size))
                    found |= owners
        # Items without an id count together as one, and no id of theirs is listed.
        digest = hashlib.sha256(",".join(sorted(found - {None})).encode()).hexdigest()
        rows.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    return ordered(rows)


def random_case():
    rng = random.Random(7)
    words = [f"w{k}" for k in range(25)] + ["é", "x9"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(30)]
    items += [(None, "w1 w2"), (99, None), (3, "w1, W2; w3"), (100, items[4][1])]
    docs = []
    for k in range(60):
        parts = rng.choices(words, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(parts))
            parts[at:at] = PLAIN_WORD.findall(rng.choice(items)[1] or "")
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(parts).upper()))
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = random_case()
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string")
    for block in (decontaminate.BLOCK_BYTES, 300):  # one block of items, and several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.report(frame, spark.createDataFrame([(*i, None) for i in items], ITEMS))
        assert ordered(got.collect()) == expected(docs, items)


def test_odd_documents_and_empty_tables(spark):
    items = [(1, "no id here"), (2, "日本語 and café"), (3, "alpha beta gamma delta " * 3)]
    frame = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    docs = odd_documents(spark)
    got = decontaminate.report(docs, frame)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert ordered(got.collect()) == expected(by_id_and_text(docs), items)
    assert decontaminate.report(no_documents(spark), frame).count() == 0
    none = decontaminate.report(docs, frame.limit(0)).collect()
    assert len(none) == len(odd_rows()) and not any(r.contaminated for r in none)


def test_removal_leaves_no_window_and_clean_documents_alone(spark):
    docs, items = random_case()
    passage = " ".join(f"p{k}" for k in range(12))
    items = [(i, t) for i, t in items if t and len(PLAIN_WORD.findall(t)) >= 10] + [(500, passage)]
    docs = [*docs, (900, f"Before it. {passage} After it."), (901, passage), (902, None), (903, "clean, as it was ")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in docs], schema)
    removed = decontaminate.remove(frame, spark.createDataFrame([(*i, None) for i in items], ITEMS))
    assert removed.columns == frame.columns
    kept = {r.doc_id: r for r in removed.collect()}
    assert not any(r[-1] for r in expected([(i, r.text) for i, r in kept.items()], items))
    for (doc_id, text), row in zip(sorted(docs), expected(sorted(docs), items), strict=False):
        if not row[-1] and row[0] == doc_id:
            assert kept[doc_id].text == text
    assert kept[900].text == "Before it.  After it." and kept[900].n_chars == 21
    assert 901 not in kept and kept[902].text is None and kept[903].text == "clean, as it was "


def test_index_finds_every_place():
    rng = np.random.default_rng(5)
    text = rng.integers(2, 6, 400)
    index = decontaminate.FmIndex(text, 6)
    assert decontaminate.suffix_order(np.array([2, 3, 2, 3, 0])).tolist() == [4, 2, 0, 3, 1]
    for size in (1, 2, 5):
        phrase = text[100 : 100 + size]
        alive, low, high = index.search(phrase[None, :], np.array([size]))
        places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert alive.tolist() == [0]
        assert places == [k for k in range(401 - size) if (text[k : k + size] == phrase).all()]
