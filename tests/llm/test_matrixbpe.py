import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from cases import by_id_and_text, no_documents, odd_documents, odd_rows, ordered

from marketpulse.llm import matrixbpe, pieces

SMALL = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def library():
    with open(matrixbpe.default_path(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def strange_texts():
    rng = random.Random(12)
    parts = [*"aaabcdeEé ’'sltxrvdm  \n\t\r\x0b\x1c\x85 123!?.#日本語\U0001f642İßΣσK", chr(160), chr(0x3000), chr(0x200B), chr(0x301)]
    parts += ["<|endoftext|>", "'ll", "'re", "'S", " the", "  ", " '", "''s"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(4000)]
    return [*texts, "", " " * 2000, "\n\n \n", " a", "a ", "aaaa aaaaa aaa"]


def long_words():
    rng = random.Random(13)
    return [
        "a" * 30_001,
        "ab" * 20_000,
        "é" * 3000,
        "".join(rng.choices("abcdefghij", k=20_000)),
        "".join(rng.choices("ACGT", k=5000)) + "x" * 700 + "!" * 900,
    ]


def encoded(own, texts):
    ids, bounds = own.encode(pa.array(texts, pa.string()))
    data, places = own.decode(ids, bounds)
    pairs = zip(bounds[:-1], bounds[1:], strict=True)
    decoded = [data[a:b].tobytes().decode() for a, b in zip(places[:-1], places[1:], strict=True)]
    return [ids[a:b].tolist() for a, b in pairs], decoded


@pytest.mark.parametrize("texts", [strange_texts(), long_words()], ids=["strange", "long"])
def test_equals_the_library(library, texts):
    ids, decoded = encoded(matrixbpe.Encoder(matrixbpe.default_path()), texts)
    assert decoded == texts
    for text, found in zip(texts, ids, strict=True):
        assert found == library.encode_ordinary(text), text[:100]


def test_every_character_is_in_the_library_s_class(library):
    characters = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000)]]
    texts = [f"{c}'s" for c in characters] + [f" {c}" for c in characters]
    ids, _ = encoded(matrixbpe.Encoder(matrixbpe.default_path()), texts)
    assert ids == [library.encode_ordinary(t) for t in texts]


def test_long_rows_equal_single_merges():
    """Ranks that are not in the order of a training, so that a merge may make a pair of lower rank."""
    rng = random.Random(14)
    for _ in range(300):
        tokens = ["a", "b", "c"]
        while len(tokens) < 14:
            joined = rng.choice(tokens) + rng.choice(tokens)
            if joined not in tokens:
                tokens.append(joined)
        order = [*range(3), *rng.sample(range(3, 14), 11)]
        of = dict(zip(tokens, order, strict=True))
        found = [(of[t[:k]], of[t[k:]], of[t]) for t in tokens for k in range(1, len(t)) if t[:k] in of and t[k:] in of]
        pairs = matrixbpe.PairTable(*np.array(found, np.int32).T)
        symbols = np.array(rng.choices(range(3), k=rng.randint(1, 40)), np.int32)
        rows = list(matrixbpe.merge_rows(symbols[None, :].copy(), pairs))
        assert matrixbpe.merge_long(symbols.copy(), pairs).tolist() == rows[0][1][0].tolist()


def test_words_of_one_hash_are_told_apart(monkeypatch):
    texts = strange_texts()[:200]
    expected, _ = encoded(matrixbpe.Encoder(matrixbpe.default_path()), texts)
    monkeypatch.setattr(pieces.words, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    own = matrixbpe.Encoder(matrixbpe.default_path())
    assert encoded(own, texts)[0] == expected
    for text, ids in zip(texts, expected, strict=True):  # against what was remembered under the same hash
        assert encoded(own, [text])[0] == [ids]


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = strange_texts()[:300]
    expected, _ = encoded(matrixbpe.Encoder(matrixbpe.default_path()), texts)
    monkeypatch.setattr(matrixbpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(matrixbpe, "CACHED_LENGTH", 2)
    monkeypatch.setattr(matrixbpe, "SHARE_BYTES", 7)
    again = matrixbpe.Encoder(matrixbpe.default_path())
    assert [encoded(again, [t])[0][0] for t in texts] == expected


def test_report(spark, library):
    docs = spark.read.parquet(SMALL).select("doc_id", "text").union(odd_documents(spark).select("doc_id", "text"))
    expected = []
    for doc_id, text in by_id_and_text(docs):
        ids = library.encode_ordinary(text or "")
        listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((doc_id, len(ids), listed, hashlib.sha256((text or "").encode()).hexdigest()))
    assert ordered(matrixbpe.report(docs).collect()) == ordered(expected)
    kept = matrixbpe.encode(odd_documents(spark), keep=["text", "ids", "found"])
    assert kept.count() == len(odd_rows()) and kept.columns[-3:] == ["text", "ids", "found"]
    assert matrixbpe.report(no_documents(spark)).count() == 0
