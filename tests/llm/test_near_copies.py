"""Near copies by the pipeline's rule: shingles of five words, 80 percent."""

from collections import defaultdict

import corpus_pipeline
import pytest
from cases import SPACE_WORD, lower, ordered
from test_jaccard import Union, near_copies

from marketpulse.llm import jaccard


def brute_force(rows, width, percent):
    union, having, sets = Union(), defaultdict(list), []
    for k, (doc_id, text) in enumerate(rows):
        words = SPACE_WORD.findall(lower(text))
        size = min(width, len(words))
        own = frozenset(tuple(words[j : j + size]) for j in range(len(words) - size + 1) if size)
        sets.append((doc_id, own))
        if doc_id is not None and own:
            common = defaultdict(int)
            for s in own:
                for j in having[s]:
                    common[j] += 1
                having[s].append(k)
            for j, n in common.items():
                if 100 * n >= percent * (len(own) + len(sets[j][1]) - n):
                    union.join(doc_id, sets[j][0])
    return ordered((i, len(s), None if i is None else union.find(i) if s else i) for i, s in sets)


@pytest.mark.parametrize("tile", [jaccard.TILE_SHINGLES, 150])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", tile)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ordered(jaccard.join(docs, width=5, percent=80).collect()) == brute_force(rows, 5, 80)


def test_stage_drops_copies_that_op8_keeps(spark):
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join(words), " ".join([*words, *(f"tail{k}" for k in range(22))]), "another text of its own words"]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.join_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]
    assert jaccard.one_of_each(docs).count() == 3
    with pytest.raises(ValueError):
        jaccard.join(docs, percent=50)
