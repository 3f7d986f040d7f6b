import hashlib
import random

import numpy as np
import pytest
from stratagraph.llm import queries
from stratagraph.llm import repeated_passages as R


def brute(rows):
    """(id, n, removed, kept) per row: a null id counts as the largest."""
    split = [(R._LAST if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, words in split:
        for k in range(len(words) - 19):
            key = b" ".join(words[k : k + 20])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for (i, words), (own, _) in zip(split, rows, strict=True):
        gone = set()
        for k in range(len(words) - 19):
            if first[b" ".join(words[k : k + 20])] < (i, k):
                gone |= set(range(k, k + 20))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        out.append((own, len(words), len(gone), kept))
    return out


def corpus(rng):
    word = lambda: f"w{rng.randrange(400)}"
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (19, 20, 21, 55, 200)]
    texts = []
    for _ in range(60):
        own = text(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(own) + 1)
            own = own[:k] + rng.choice(passages) + own[k:]
        texts.append(own)
    texts += [passages[4], passages[4][:150] + text(3) + passages[4][150:], ["a", "b"] * 60, ["x"] * 45, ["x"] * 20, ["x"] * 19]
    texts += [list(texts[5]), list(texts[5]), list(texts[60])]  # whole copies
    joined = [" ".join(t) for t in texts]
    joined += ["", " \t\n", None, joined[3].replace(" ", "\n"), "é é  " * 30]
    rows = list(enumerate(joined))
    rng.shuffle(rows)
    return rows + [(7, joined[7]), (7, joined[7]), (8, joined[61]), (None, joined[62]), (None, "new " * 25), (None, joined[64])]


def checked(spark, rows, tmp):
    spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, kept string, start int").write.parquet(f"{tmp}/documents.parquet")
    df = spark.read.parquet(f"{tmp}/documents.parquet")
    got = R.drop_repeats(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    digest = queries.op11_count_min_passages(spark, str(tmp))
    want = [(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute(rows)]
    assert sorted(map(repr, map(tuple, digest.collect()))) == sorted(map(repr, want))


def test_equals_brute_force(spark, tmp_path):
    checked(spark, corpus(random.Random(3)), tmp_path)


@pytest.mark.parametrize(("bits", "cut"), [(5, 3), (9, 4), (30, 26)])
def test_a_crowded_sketch_loses_nothing(spark, bits, cut):
    """Few counters: estimates are far too high, the result is the same."""
    rows = corpus(random.Random(4))
    got = R.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), bits=bits, cut=cut).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))


def test_many_batches(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        checked(spark, corpus(random.Random(9)), tmp_path)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")


def test_rolled_hashes():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 63, 50, np.uint64)
    for width in (1, 2, 8, 20):
        got = R._rolled(words, width, R._BASE[0])
        want = [sum(int(w) * pow(R._BASE[0], width - 1 - k, 1 << 64) for k, w in enumerate(words[i : i + width])) % (1 << 64) for i in range(50 - width + 1)]
        assert got.tolist() == want


def test_equal_windows_are_counted_at_equal_runs():
    rng = random.Random(2)
    text = [rng.choice("ab") for _ in range(300)]
    own = R.Batch([" ".join(text).encode()])
    place, runs = own.runs()
    by = {}
    for k in range(281):
        by.setdefault(tuple(text[k : k + 20]), []).append(k)
        assert k <= place[k] <= k + 12
    for starts in by.values():
        assert len({int(runs[k]) for k in starts}) == 1 and len({int(place[k]) for k in starts}) == len(starts)


def test_empty_and_very_long(spark):
    assert R.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(12)
    half = " ".join(str(rng.randrange(10**6)) for _ in range(150_000))
    r = R.drop_repeats(spark.createDataFrame([(1, f"{half} {half}")], "doc_id long, text string")).first()
    assert (r.n_words, r.n_removed, r.kept) == (300_000, 150_000, half)
