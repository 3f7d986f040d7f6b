import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from stratagraph.llm import periodic_runs as P
from stratagraph.llm import queries


def brute(words, least):
    """Every run by trying every period."""
    found = []
    for q in range(1, len(words) // 2 + 1):
        x = 0
        while x + q < len(words):
            if words[x] != words[x + q]:
                x += 1
                continue
            a = x
            while x + q < len(words) and words[x] == words[x + q]:
                x += 1
            part = words[a : x + q]
            if len(part) >= max(least, 2 * q) and not any(part[z:] == part[:-z] for z in range(1, q)):
                found.append((a, len(part), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for t in range(1500):
        n, k = rng.randrange(0, 60), rng.randrange(1, 5)
        words = [rng.randrange(k) for _ in range(n)]
        if t % 2:
            part = [rng.randrange(k) for _ in range(rng.randrange(1, 12))]
            words = (part * 60)[:n]
            for _ in range(rng.randrange(3) if n else 0):
                words[rng.randrange(n)] = rng.randrange(k + 2)
        for least in (2, 12):
            assert P.find(np.array(words, np.int64), least) == brute(words, least), (words, least)


def test_extensions_equal_their_definition():
    rng = random.Random(6)
    for _ in range(800):
        s = [rng.randrange(rng.randrange(1, 4)) for _ in range(rng.randrange(0, 40))]
        n = len(s)
        nss, right = P.right_extensions(s)
        assert nss == [next((j for j in range(i + 1, n) if s[j:] < s[i:]), n) for i in range(n)]
        left = P.left_extensions(s, nss)
        for i, j in enumerate(nss):
            if j < n:
                assert right[i] == next((k for k in range(n) if j + k == n or s[i + k] != s[j + k]), 0)
                assert left[i] == next((k for k in range(n + 1) if i - k == 0 or s[i - k - 1] != s[j - k - 1]), 0)


class Counted(list):
    reads = 0

    def __getitem__(self, at):
        Counted.reads += 1
        return list.__getitem__(self, at)


def _fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("word", [[0] * 20000, [0, 1] * 10000, _fibonacci(20000), ([0] * 99 + [1]) * 200, list(range(140)) * 140])
def test_work_is_linear(word):
    for order in (word, [max(word) - w for w in word]):
        Counted.reads = 0
        nss, _ = P.right_extensions(Counted(order))
        P.left_extensions(Counted(order), nss)
        assert Counted.reads < 12 * len(word)  # a comparison reads twice


def test_whole_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 90))) for _ in range(120)]
    texts = [*base, None, "", " \n\t ", "x " * 40, base[0], "é é " * 13, "one\u0085two\x1c " * 20]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(3, base[3], "x", "y"), (3, base[3], "x", "y"), (None, "z " * 30, "x", "y")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, best string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_lyndon_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        n = len(words)
        if i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
            g = zlib.crc32(str(i).encode()) // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        kept = [w for k, w in enumerate(words) if not any(a + q <= k < a + m for a, m, q in runs)]
        want.append(
            (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
             hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())
        )
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert any(w[1] for w in want)


def test_longest_run_ties(spark):
    rows = [("a b " * 6 + "| " + "c d " * 6).strip()]
    df = spark.createDataFrame([(2, t) for t in rows], "doc_id long, text string")
    r = P.digests(P.find_runs(df)).first()
    assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (2, 0, 12, 2, 6000)


def test_empty_and_very_long(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.find_runs(df).count() == 0
    rng = random.Random(8)
    long = " ".join(str(rng.randrange(300)) for _ in range(150_000)) + " a b c" * 50_000
    began = time.time()
    r = P.find_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert time.time() - began < 60
    assert {"start": 150_000, "length": 150_000, "period": 3} in [x.asDict() for x in r.runs]
    assert len(r.collapsed.split()) == 150_003
