import random

import pytest
import xxhash

from stratagraph.llm import simhash


def brute_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_matches_brute_force(monkeypatch):
    rng = random.Random(3)
    texts = ["", " \n", "One", "ÄB ß one", "a b c", "a b c d " * 40, "x\x0by z w q"]
    texts += [" ".join(rng.choice(["Alpha", "beta", "gam\nma", "δ", "e  f"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    want = [brute_print(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    for size in (1, 7, 40):  # sliced texts give the same
        monkeypatch.setattr(simhash, "_SLICE", size)
        assert [simhash.fingerprint(t) for t in texts] == want


@pytest.mark.parametrize("most", [512, 2])
def test_components_match_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAX_GROUP", most)
    rng = random.Random(5)
    prints = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(200):
        x = rng.choice(prints)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    prints += [0, 1 << 63, (1 << 64) - 1, 0]
    rows = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(prints)], "key long, fp long")
    if most == 2:  # groups of up to 256 exist at the last level, so only whole results count
        monkeypatch.setattr(simhash, "MAX_GROUP", 2)
    got = {r.fp: r.first for r in simhash._classes(rows).collect()}
    assert [got[signed(p)] for p in prints] == brute_components(prints)


def test_edge_cases_and_drop(spark):
    rows = [(5, "same words here now", "x"), (2, "same words here now", "y"), (2, "same words here now", "y"), (7, None, "z"), (9, "", "z"), (None, "other text entirely different", "q"), (3, "other text entirely different", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.simhash_components(df).collect())
    assert got == [(-1, 3), (2, 2), (2, 2), (3, 3), (5, 2), (7, 7), (9, 7)]
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7]
    assert simhash.simhash_components(df.limit(0)).count() == 0
    assert simhash.drop_near_copies(df.limit(0)).count() == 0
