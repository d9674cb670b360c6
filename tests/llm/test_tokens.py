import random
import zlib

import numpy as np
import pytest

from contactspark.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, world!! it's 12 o'clock", "", None, "ÀÉ naïve, façade... l'été <|endoftext|> x<|endoftext|>", "ΣΑΣ İ é é ﬁ ① ٣", "a\x1cb\x85c d\te\x0bf", "wörd*** under_score __ 'tis 'S foo's. (x)", "語 日本 " * 50, "don't DON'T y'all'd've", "TÜRKİYE CUMHURİYETİ. Sonra", "İ. x", "İ, a"]


def truth(rows):
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(PATH), 0, []
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 777)
    packed = tokens.pack(ids, bits)
    assert len(packed) == -(-777 * bits // 8)
    assert (tokens.unpack(packed, bits, 0, 777) == ids).all() and (tokens.unpack(packed, bits, 131, 40) == ids[131:171]).all()


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        encoder, library = tokens.Encoder(path), Tokenizer.from_file(path)
        assert encoder.by_word == (name == "word_bpe_49k.json")
        for text, ids in zip(TEXTS, encoder.encode(TEXTS)):
            assert np.frombuffer(ids, encoder.kind).tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_random_letters():
    r, encoder = random.Random(5), tokens.Encoder(PATH)
    texts = ["".join(r.choices("aBIİıſŉǰ'sté.,-!(x) \n\t1Æɏ|<>&", k=r.randint(0, 30))) for _ in range(5000)]
    assert encoder.encode(texts) == encoder._raw(texts)


def test_round_trip(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 40)
    rows = [(i * 3, TEXTS[i % len(TEXTS)]) for i in range(60)] + [(-5, "first"), (None, "null id"), (2**53 + 1, "large id")]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS tie")
    path = f"{tmp_path}/ids"
    tokens.write_ids(docs, path, PATH, partitions=7)
    blocks = tokens.open_ids(spark, path)
    out = sorted((tuple(r) for r in tokens.digests(blocks).collect()), key=lambda r: r[1])
    assert out == truth(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    one = tokens.read_document(blocks, 3)
    assert len(one) == 1 and zlib.crc32(one[0].astype("<u4").tobytes()) == next(r[3] for r in out if r[0] == 3)


def test_empty_and_repeated(spark):
    assert tokens.written(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    out = tokens.written(spark.createDataFrame([(1, "x"), (1, "x"), (1, "y z")], "doc_id long, text string"), PATH).collect()
    assert sorted(r.n_tokens for r in out) == [2, 2, 3] and sorted(r.start for r in out)[0] == 0
