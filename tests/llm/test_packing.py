import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stratagraph.llm import packing, tokenise


def library(path):
    return tokenise.load(path)


TEXTS = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb c", "x\ty z", "It's we'll  don't\n 'tis", "<|endoftext|> and <|startoftext|> x<|endoftext|>y", "é́ ΑΣ ΟΔΟΣ. σ q",
    "a\0b c", "日本語 テキスト", "1234 5 6\x1c7\x85 8", "…!!!??? ###", " x   y", "end\r\nnew\rline", "Á é\ń z",
]


def hard_texts():
    rng = random.Random(2)
    bits = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "!", "Σ", "日", "\xa0", "\u2003", "x y", "\x1f", "\u0301", "|", " |", ".", ",", "word", "Été", "H\u0331", "it's", "ß", "İ", "ǅ"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(2000)]
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    texts += [every[at : at + 997] for at in range(0, len(every), 99_700)] + [f"a{every[at]} {every[at]}1{every[at]}" for at in range(0, len(every), 211)]
    return texts + ["x" * 5000 + " y", " " * 5000 + "y", "\n \t" * 900, "日本" * 3000]


def test_byte_ids_equal_the_library():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokenise.ByteEncoder(path)
    for t in hard_texts():
        assert encoder.encode(t).tolist() == library(path).encode(t, add_special_tokens=False).ids, repr(t)


def test_word_ids_equal_the_library():
    import public_tokenizers

    path, texts = public_tokenizers.path("word_bpe_49k.json"), hard_texts()
    encoder, found = tokenise.WordEncoder(path), {}
    for own, group, uneven in tokenise.groups(pa.array(texts), most=900):
        ids, at = encoder.encode(group, uneven)
        found |= {i: ids[lo:hi].tolist() for i, lo, hi in zip(own, at[:-1], at[1:], strict=True)}
    for i, t in enumerate(texts):
        assert found[i] == library(path).encode(t, add_special_tokens=False).ids, repr(t)


def test_cache_is_bounded_and_exact(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(tokenise, "CACHE", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = tokenise.WordEncoder(path)
    for i in range(50):
        text = " ".join(f"w{i}x{k}" for k in range(i))
        assert encoder.encode([text])[0].tolist() == library(path).encode(text, add_special_tokens=False).ids
        assert len(encoder.cache) <= 20 + i


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_all_and_fills_closest(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 64): rng.randrange(1, 9) for _ in range(12)}
    left, steps = dict(counts), packing.plan(counts, 64)
    for step, (_, times, used, filler, head) in enumerate(steps):
        fill = sum(n * k for n, k in used)
        sums = {0}
        for n, c in left.items():
            sums |= {s + n * k for s in sums for k in range(c + 1) if s + n * k <= 64}
        assert fill == max(sums) and times > 0
        assert fill + head == 64 or step == len(steps) - 1
        for n, k in [*used, *([(filler, 1)] if filler else [])]:
            left[n] -= k * times
        assert min(left.values()) >= 0
        if filler:
            left[filler - head] = left.get(filler - head, 0) + times
    assert not any(left.values())


@pytest.mark.parametrize("counts", [{600: 7}, {1: 5000}, {1023: 40}, {513: 9, 700: 4}, {1000: 1}, {900: 30, 3: 1, 124: 2}, dict.fromkeys(range(1, 1024), 3), {}])
def test_slots_place_every_id_once(counts):
    of, seen = defaultdict(list), defaultdict(list)
    for length, low, high, skip, many, base, copies, first, offset in packing.slots(counts, 1024):
        for n in range(low, high):
            k = n - low + base
            seen[length, n].append((skip, many))
            of[first + k // copies].append((offset + k % copies * many, many))
    assert set(seen) == {(n, i) for n, c in counts.items() for i in range(c)}
    for (length, _), parts in seen.items():
        at = 0
        for skip, many in sorted(parts):
            assert skip == at and many > 0
            at += many
        assert at == length
    for w, parts in of.items():
        at = 0
        for offset, many in sorted(parts):
            assert offset == at
            at += many
        assert at == 1024 or w == max(of)
    assert sorted(of) == list(range(-(-sum(n * c for n, c in counts.items()) // 1024)))
    assert len(packing.plan(counts, 1024)) < 4000


def check_pack(rows, documents, window=1024):
    import public_tokenizers

    tok = library(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in documents:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert sorted(by_seq) == list(range(len(by_seq)))
    return padding


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs).collect()
    padding = check_pack(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert padding < 1024  # only the last sequence has any


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x " * 5000, "c"), (4, "hello " * 700, "d")], "doc_id long, text string, start string")
    check_pack(packing.pack(df).collect(), [(r.doc_id, r.text) for r in df.collect()])
    twice = spark.createDataFrame([(1, "same text")] * 300 + [(None, "same text")], "doc_id long, text string")
    got = packing.pack(twice).collect()
    assert len(got) == 301 and len({(r.sequence_id, r.offset) for r in got}) == 301
    assert packing.pack(df.limit(0)).count() == 0
    ids = packing.pack(df, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in ids)
    hard = spark.createDataFrame([(i, "x " * 320) for i in range(60)], "doc_id long, text string")  # no two fit one window
    assert check_pack(packing.pack(hard).collect(), [(r.doc_id, r.text) for r in hard.collect()]) <= 1024


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, "word " * 150_000 + "x" * 60_000 + " " * 60_000), (2, "日本" * 30_000), (3, "short")], "doc_id long, text string")
    assert check_pack(packing.pack(df).collect(), [(r.doc_id, r.text) for r in df.collect()]) < 1024
