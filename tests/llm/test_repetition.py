from collections import Counter

import pyarrow as pa

from marketpulse.llm import repetition
from cases import SPACE_WORD, by_id_and_text, no_documents, odd_documents, ordered

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def measures(text):
    text = text or ""
    words = SPACE_WORD.findall(text)

    def inside(n, again):
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        counts, seen, hit = Counter(grams), set(), set()
        for k, g in enumerate(grams):
            if counts[g] > 1 and (not again or g in seen):
                hit.update(range(k, k + n))
            seen.add(g)
        return hit

    seen, dup, line_chars, dup_chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if SPACE_WORD.search(line):
            line_chars += len(line)
            if line in seen:
                dup += 1
                dup_chars += len(line)
            seen.add(line)
    chars = sum(map(len, words))
    repeat = len(inside(8, False))
    failed = len(words) < 20 or 100 * repeat > 30 * len(words)
    over = dup_chars > repetition.LINE_LIMIT * line_chars
    for n, limit in repetition.GRAM_LIMITS.items():
        over |= sum(len(words[k]) for k in inside(n, True)) > limit * chars
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), chars, symbols, dup, repeat, failed, not failed and not over


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").union(
        spark.createDataFrame([(-1, "one two three four five six seven " * 9, "", "", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    got = repetition.report(docs).select(COLUMNS)
    assert ordered(got.collect()) == ordered((i, *measures(t)) for i, t in by_id_and_text(docs))


def test_odd_documents_and_empty_table(spark):
    docs = odd_documents(spark)
    rows = [(i, t) for i, t in by_id_and_text(docs) if len(t or "") < 10_000]
    got = [r for r in repetition.report(docs).select(COLUMNS).collect() if r.n_words < 1000]
    assert ordered(got) == ordered((i, *measures(t)) for i, t in rows)
    assert repetition.report(no_documents(spark)).count() == 0


def test_a_text_measures_the_same_among_others():
    texts = ["a b c d e f g h " * 4, "", "x\nx\ny", "a b c d e f g h " * 4]
    together = repetition.measure(pa.array(texts))
    for k, text in enumerate(texts):
        alone = repetition.measure(pa.array([text]))
        assert {n: v[k] for n, v in together.items()} == {n: v[0] for n, v in alone.items()}
