import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from cases import by_id_and_text, no_documents, odd_documents, odd_rows, ordered
from tokenizers import Tokenizer

from marketpulse.llm import bpe, frames, tokenfiles

SMALL = "/root/testdata/sf0.001/documents.parquet"


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(tokenfiles.default_path())


def strange_texts():
    rng = random.Random(11)
    parts = [*"aaabcdeEé ’'sltx  \n\t\r\x0b\x1c\x85 123!?.#日本語\U0001f642İßΣσK", chr(160), chr(0x3000), chr(0x200B), chr(0x301)]
    parts += ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", " the", "  "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(4000)]
    return [*texts, "", "a" * 3000, " " * 2000, "ab" * 2000, "\n\n \n", " a", "a ", " <|endoftext|> x", "aaaa aaaaa aaa"]


def test_encoding_equals_the_library(byte_level):
    texts, own = strange_texts(), bpe.Encoder(bpe.default_path())
    found = own.encode(texts)
    for text, ids, other in zip(texts, found, byte_level.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == other.ids, text
        assert own.decode(ids) == byte_level.decode(other.ids, skip_special_tokens=False) == text


def test_forgetting_pieces_changes_nothing(monkeypatch):
    texts = strange_texts()[:300]
    own = bpe.Encoder(bpe.default_path())
    expected = [x.tolist() for x in own.encode(texts)]
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    monkeypatch.setattr(bpe, "CACHED_LENGTH", 2)
    again = bpe.Encoder(bpe.default_path())
    assert [again.encode([t])[0].tolist() for t in texts] == expected


def test_merges_use_earlier_symbols_only():
    vocabulary = bpe.Vocabulary(bpe.default_path())
    made = {int(m): rank for rank, m in enumerate(vocabulary.merged)}
    for rank, pair in enumerate(zip(vocabulary.left.tolist(), vocabulary.right.tolist(), strict=True)):
        assert all(made.get(symbol, -1) < rank for symbol in pair)


def test_report(spark, byte_level):
    docs = spark.read.parquet(SMALL).select("doc_id", "text").union(odd_documents(spark).select("doc_id", "text"))
    expected = []
    for doc_id, text in by_id_and_text(docs):
        ids = byte_level.encode(text or "", add_special_tokens=False).ids
        listed = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.append((doc_id, len(ids), listed, hashlib.sha256((text or "").encode()).hexdigest()))
    assert ordered(bpe.report(docs).collect()) == ordered(expected)
    kept = bpe.encode(odd_documents(spark), keep=["text", "ids", "found"])
    assert kept.count() == len(odd_rows()) and kept.columns[-3:] == ["text", "ids", "found"]
    assert bpe.report(no_documents(spark)).count() == 0


def test_word_encoding_equals_the_library(word_level):
    texts, own = strange_texts(), tokenfiles.Encoder(tokenfiles.default_path())
    for text, ids, other in zip(texts, own.encode(texts), word_level.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == [*other.ids, tokenfiles.END_ID], text


def expected_rows(docs, word_level):
    start, rows = 0, []
    for doc_id, text in sorted(by_id_and_text(docs), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*word_level.encode(text or "", add_special_tokens=False).ids, 1]
        rows.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_files_hold_all_ids_in_order(spark, word_level):
    docs = spark.read.parquet(SMALL)
    assert sorted(map(tuple, tokenfiles.report(docs).collect())) == expected_rows(docs, word_level)


def test_odd_documents(spark, word_level):
    docs = odd_documents(spark)
    got = tokenfiles.report(docs).collect()
    rows = expected_rows(docs, word_level)
    assert ordered((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == ordered((a, c, d) for a, _, c, d in rows)
    placed = sorted((r.start, r.n_tokens) for r in got)
    assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:], strict=False))
    assert tokenfiles.report(no_documents(spark)).count() == 0


def test_sequences_are_read_in_place(spark, word_level):
    docs, length = spark.read.parquet(SMALL), 64
    folder = frames.shared_folder(spark, "sequences")
    files = tokenfiles.write(docs, folder, length=length).orderBy("part").collect()
    tokens = sum(len(word_level.encode(t, add_special_tokens=False).ids) + 1 for _, t in by_id_and_text(docs))
    assert sum(f.tokens for f in files) == tokens and sum(f.documents for f in files) == docs.count()
    _, place = pafs.FileSystem.from_uri(folder)
    for f in files:
        with pa.memory_map(f"{place}/{f.file}.ids") as source:
            before = pa.total_allocated_bytes()
            file = pa.ipc.open_file(source)
            batches = [file.get_batch(k) for k in range(file.num_record_batches)]
            assert pa.total_allocated_bytes() - before < 4096  # views of the mapped file
            assert all(b.column(c).type.list_size == length for b in batches for c in ("ids", "mask"))
            flat = [b.column("mask").flatten() for b in batches]
            masks = np.concatenate([x.to_numpy(zero_copy_only=False).reshape(-1, length).sum(axis=1) for x in flat])
            assert not np.diff(np.concatenate([x.to_numpy(zero_copy_only=False) for x in flat]).astype(int)).max(initial=0) > 0
            assert masks.sum() == f.tokens and (masks[:-1] == length).all()
