import random
import re
from collections import Counter

import numpy as np

from stratagraph.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(3)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(inside)


def texts():
    rng = random.Random(1)
    vocabulary = ["a", "bé", "c#", "日本", "d|", "x y", "\x1c", "end."]
    return ["", " ", "\n\n", "a", "a b", "a b c", "a b c d a b c", "x\nx\n \n \nx\r\nx\r"] + [
        "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", "\t", "\x0b"]) for _ in range(rng.randrange(120))) for _ in range(60)
    ]


def test_counts_match_brute_force():
    for t in texts():
        assert Q.counts(t)[:5] == brute(t), t


def test_estimate_separates_planted_classes():
    rng = np.random.default_rng(0)
    good = rng.random(4000) < 0.8
    right = rng.random((4000, 9)) < 0.9
    votes = np.where(right, np.where(good[:, None], 1, -1), 0)
    patterns, inverse, times = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, table, share = Q.estimate(patterns, times.astype(float))
    assert abs(share - good.mean()) < 0.02
    assert ((posterior[inverse.ravel()] >= 0.5) == good).mean() > 0.99
    assert (table[1, :, 2] > table[0, :, 2]).all()


def test_query_and_filter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in Q.judge(docs).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == brute(r.text)
        assert g.base_failed == (g.n_words < 50 or 100 * g.n_repeat_words > 50 * g.n_words)
        assert not (g.base_failed and g.kept)
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (None, "", 9), (2, "word " * 60, 9), (2, "word " * 60, 9)], "doc_id long, text string, pattern int")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in Q.judge(df).collect())
    assert got == [(0, 0, True, False), (1, 0, True, False), (2, 60, True, False), (2, 60, True, False)]
    assert Q.judge(df.limit(0)).count() == 0 and Q.keep_good(df.limit(0)).count() == 0
    assert Q.keep_good(df).columns == df.columns


def plain_em(votes):
    """The same estimate over documents one by one, in plain loops."""
    import math

    n, rules = len(votes), len(votes[0])
    prior = {0: [2.0, 1.0, 0.5], 1: [0.02, 1.0, 2.0]}
    good = [1 / (1 + math.exp(3.0 * v.count(-1) - 0.5 * v.count(1) - 0.5)) for v in votes]
    for _ in range(200):
        table = {}
        for c in (0, 1):
            for r in range(rules):
                own = [prior[c][k] * n / 400 + 1e-9 for k in range(3)]
                for v, g in zip(votes, good):
                    own[v[r] + 1] += g if c else 1 - g
                table[c, r] = [x / sum(own) for x in own]
        share = (sum(good) + 1) / (n + 2)
        new = []
        for v in votes:
            odds = math.log(share / (1 - share)) + sum(math.log(table[1, r][v[r] + 1] / table[0, r][v[r] + 1]) for r in range(rules))
            new.append(1 / (1 + math.exp(-max(-700, min(700, odds)))))
        moved = max(abs(a - b) for a, b in zip(new, good))
        good = new
        if moved < 1e-9:
            break
    return good


def test_kept_equals_plain_em(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counted = Q.with_counts(docs.select("doc_id", "text"))
    rows = counted.select("doc_id", *[v.alias(f"v{k}") for k, v in enumerate(Q.rules().values())]).collect()
    posterior = dict(zip([r.doc_id for r in rows], plain_em([[r[f"v{k}"] for k in range(len(Q.rules()))] for r in rows])))
    got = Q.judge(docs).collect()
    assert all(abs(r.posterior - posterior[r.doc_id]) < 1e-6 for r in got)
    assert all(r.kept == (not r.base_failed and posterior[r.doc_id] >= 0.5) for r in got)


def test_very_long_texts(spark):
    long = "Some plain words of prose, again. " * 60_000 + "\n" * 100_000 + "x" * 1_000_000
    df = spark.createDataFrame([(1, long), (2, "\n".join(["same line"] * 50_000))], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert (got[1].n_words, got[1].n_dup_lines) == (360_001, 0) and got[2].n_dup_lines == 49_999
    assert got[1].n_repeat_words == brute(long)[4] and not got[1].kept
