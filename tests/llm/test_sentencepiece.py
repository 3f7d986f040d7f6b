import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from stratagraph.llm import sentencepiece_bpe as S
from stratagraph.llm import tokenise


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=S.default_model())


def texts():
    rng = random.Random(4)
    bits = ["a", "b", "ab", "aa", "the ", " ", "  ", "▁", "\n", "\t", "é", "日", "本", "😀", "x", "ing", "<s>", "</s>", "<0x41>", "1", "11", ".", "...", "\0", "ﬁ", "Z", "===", "-"]
    out = ["", " ", "a", "aaaaaaa", "abababab" * 9, "▁", "  x ", "\n\ty", "-" * 301, "=" * 200 + "a" * 99, "a" * 1000, "ab" * 777, "日本語" * 300] + [" " * k + "the" for k in range(70)] + [" " * k for k in range(70)] + [" " * 50_000 + "x"]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(4000)]


def test_encode_equals_the_library(library):
    every, encoder = texts(), S.Encoder(S.default_model())
    for own, group, uneven in S.groups(pa.array(every), S._uneven, 5000):
        ids, at = encoder.encode(group, uneven)
        for i, lo, hi in zip(own, at[:-1], at[1:], strict=True):
            assert ids[lo:hi].tolist() == library.encode(every[i]), repr(every[i])


def unspaced(rng, n):
    every = [i for i in range(259, 32000)]
    yield "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    yield "".join(rng.choice("aeinrst") for _ in range(n))
    yield "".join(rng.choice("ab") for _ in range(n))
    yield "".join(rng.choice("0123456789abcdefABCDEF+/=") for _ in range(n))
    yield "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(n))
    yield "".join(rng.choice(["the", "ing", "tion", "ther", "e", "s", "é", "日", "un", "able", "ab", "in"]) for _ in range(n // 3))
    pieces = S.load(S.default_model()).pieces
    yield "".join(pieces[rng.choice(every)].replace(S.MARK, "") for _ in range(n // 4))
    yield "".join(pieces[rng.choice(every)].replace(S.MARK, "")[rng.randrange(3) :] for _ in range(n // 4))


def test_long_words_equal_the_library(library):
    rng, encoder = random.Random(8), S.Encoder(S.default_model())
    for n in (70, 300, 3000, 40_000):
        for _ in range(30 if n < 3000 else 3 if n < 40_000 else 1):
            for t in unspaced(rng, n):
                assert encoder.encode([t])[0].tolist() == library.encode(t), t[:200]


def test_a_megabyte_without_a_space(library):
    import time

    rng, encoder = random.Random(2), S.Encoder(S.default_model())
    for letters in ("abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ACGT"):
        text = "".join(rng.choice(letters) for _ in range(1 << 20))
        began = time.time()
        ids = encoder.encode([text])[0]
        assert time.time() - began < 15
        assert ids.tolist() == library.encode(text)


def test_decode_equals_the_library(library):
    model, rng = S.load(S.default_model()), random.Random(6)
    for t in texts():
        ids = [*library.encode(t), 2]
        assert model.decode(np.array(ids), np.array([0, len(ids)])) == [library.decode(ids)], repr(t)
    every = []
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 0, 1, 2, 28705]) for _ in range(rng.randrange(9))]
        every.append(ids)
    offsets = np.cumsum([0, *map(len, every)])
    for ids, got in zip(every, model.decode(np.array(sum(every, [])), offsets), strict=True):
        assert got == library.decode(ids), ids


def test_small_cache(library, monkeypatch):
    monkeypatch.setattr(tokenise, "CACHE", 30)
    encoder = S.Encoder(S.default_model())
    for t in texts()[:300]:
        assert encoder.encode([t])[0].tolist() == library.encode(t)


def test_query(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in S.digests(S.decode(S.encode(docs))).collect()}
    for r in docs.collect():
        ids = [*library.encode(r.text), 2]
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (None, "", 2), (3, "a b", 3), (3, "a b", 3)], "doc_id long, text string, ids int")
    rows = S.decode(S.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in rows) == [(0, [2], ""), (1, [2], ""), (3, [264, 287, 2], "a b"), (3, [264, 287, 2], "a b")]
    assert S.encode(df.limit(0)).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert S.decode(none).first().decoded == ""
