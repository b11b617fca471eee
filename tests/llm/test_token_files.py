"""Token files: ids against the tokenizer's own, places, and the reading of one document."""

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillon.llm import token_files
from tests.llm import fixtures

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "It's the dog's <|endoftext|> <|startoftext|>x", "tab\there\x0b\x0c\r\n\x1c\x1d   é ", "ΣΑΣ ΟΔΟΣΣ İstanbul", "é ́a", "... ,. a.b C.D.", "Word. word, WORD! w0rd 12 3 a1b",
    "don't we've I'll", "中文 mixed中", "a​b", "x" * 5000, "",
]


def tokens(text):
    return [*tokens.tokenizer.encode(text or "", add_special_tokens=False).ids, token_files.END]


tokens.tokenizer = Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer(spark):
    texts = ODD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = token_files.Encoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokens(t) for t in texts]


def test_encoder_on_random_texts_and_any_file():
    rng = random.Random(5)
    signs = "abzABZ'éÉßñ,.;!?*<>|0 19\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 İıΣσςÅKﬁ中文🙂sS-_"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(20_000)]
    texts += ["a" * 70_000 + " " + "a" * 69_999 + "b", "<|STARTOFTEXT|> <|startoftext|>", None]
    encoder = token_files.Encoder(PATH)
    assert encoder.by_pieces
    assert [np.frombuffer(g, "<u4").tolist() for g in encoder.encode(texts)] == [tokens(t) for t in texts]
    other = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))  # keeps white space and case
    assert not other.by_pieces
    assert np.frombuffer(other.encode(["A  b\n c"], 9)[0], "<u4").tolist() == [*other.tokenizer.encode("A  b\n c", add_special_tokens=False).ids, 9]


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE", 20)
    encoder = token_files.Encoder(PATH)
    texts = [f"word{i % 7}a x{'abc'[i % 3]} {chr(97 + i % 26) * 3} common" for i in range(300)]
    for t in texts:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == tokens(t)


@pytest.mark.parametrize("segment", [2 << 20, 2000])
def test_round_trip(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(token_files, "SEGMENT", segment)
    path = fixtures.documents(spark, tmp_path / "odd")
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    docs.sort(key=lambda d: (d[0] is not None, d[0] or 0, zlib.crc32((d[1] or "").encode())))
    want, start = [], 0
    for i, t in docs:
        ids = np.array(tokens(t), "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in token_files.op9_zstd_token_files(spark, path).collect()), key=key) == want
    folder = f"{tmp_path}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(spark.read.parquet(f"{path}/documents.parquet"), folder, PATH)
    assert token_files.read_document(spark, folder, 7) == tokens(fixtures.TEXTS[7])
    assert token_files.read_document(spark, folder, 12) == tokens(fixtures.TEXTS[12])
    assert token_files.read_document(spark, folder, 999) is None
    with pytest.raises(ValueError):
        token_files.index_of(token_files.segment_bytes(b"x" * 32, []), b"y" * 32)


def test_empty(spark, tmp_path):
    assert token_files.op9_zstd_token_files(spark, fixtures.empty(spark, tmp_path)).count() == 0
