import math
import random
import re
from collections import Counter

import pytest
from stratagraph.llm import queries
from stratagraph.llm import tiered_search as T

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    """(item_id, rank, doc_id, score) by scoring every document."""
    split = [(T._LAST if i is None else i, Counter(w.translate(LOWER) for w in TERM.findall(t or ""))) for i, t in docs]
    n_docs, length = sum(1 for _, c in split if c), sum(sum(c.values()) for _, c in split)
    df = Counter(w for _, c in split for w in c)
    out = []
    for item, text in items:
        asked = Counter(w.translate(LOWER) for w in TERM.findall(text or ""))
        scores = []
        for i, c in split:
            n, s = sum(c.values()), 0
            for w, k in asked.items():
                if w in c:
                    m = 100 - 75 + (75 * n * n_docs) // length
                    s += k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m))
            if s > 0:
                scores.append((-s, i))
        out += [(item, r, None if i == T._LAST else i, -s) for r, (s, i) in enumerate(sorted(scores)[:10], 1)]
    return sorted(map(repr, out))


def corpus(rng):
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(300)]
    docs = [(i, " ".join(rng.choice(common) if rng.random() < 0.8 else rng.choice(rare) for _ in range(rng.randrange(1, 80)))) for i in range(500)]
    docs += [(500 + k, " ".join(["needle", "c1"] * (k + 1) + rng.choices(rare, k=5))) for k in range(15)]
    docs += [(600, None), (601, ""), (602, "!? -"), (603, "Ünï ünï ÜNÏ Über É9 a_b\x00c\x7fd"), (604, "needle " * 3000), (3, docs[3][1]), (3, docs[3][1]), (None, "needle c1 r5"), (700, docs[20][1])]
    items = [(1, "needle"), (2, "c0 c1 c2 c3"), (3, "Needle r1 R2 r3 c0"), (4, "c5"), (5, ""), (6, None), (7, "nowhere at all"), (8, "Über ünï É9"), (9, "c1 c1 c1 r7 r7"), (1, "c2 r9"), (10, " ".join(common + rare)), (None, "r11 r12"), (11, "a b d"), (4, "c5")]
    return docs, items


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, terms string").repartition(5),
        spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, score string"),
    )


@pytest.mark.parametrize("least", [(128, 1024), (2, 8)])
def test_equals_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(T, "LEAST", least)
    docs, items = corpus(random.Random(4))
    got = T.search(*tables(spark, docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(docs, items)


def test_batches_read_again_hold_other_rows(spark, monkeypatch):
    """More files than tasks, short batches: a batch that is read has rows of several that were written."""
    monkeypatch.setattr(T, "LEAST", (16, 64))
    monkeypatch.setattr(T, "bounded_batches", lambda spark: None)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        docs, items = corpus(random.Random(4))
        documents, asked = tables(spark, docs, items)
        got = T.search(documents.repartition(40), asked).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(map(repr, map(tuple, got))) == brute(docs, items)


def test_small_groups_of_items(spark):
    docs, items = corpus(random.Random(5))
    got = T.search(*tables(spark, docs, items), most=40)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute(docs, items)


def test_items_end_at_the_tier_that_proves_them(spark, monkeypatch):
    monkeypatch.setattr(T, "LEAST", (16, 64))
    docs, _ = corpus(random.Random(6))
    df = spark.createDataFrame([(T._LAST if i is None else i, t or "") for i, t in docs], "id long, text string")
    texts = ["needle c1", "c0 c1 c2 c3 c4", "r1", "c3 r1 needle"]
    counts = [Counter(T.terms(t.encode())) for t in texts]
    known = {w: k for k, w in enumerate(sorted(set().union(*counts)))}
    index, at = T.Index(df, known), {}
    wanted = [(k, index.weights({known[w]: n for w, n in c.items()})) for k, c in enumerate(counts)]
    got = sorted((k, r, i, s) for k, i, s, r in map(tuple, index.search(wanted, at).collect()))
    assert set(at) == {0, 1, 2, 3} and at[2] == 1  # a rare term lies whole in the first tier
    assert at[1] == 3  # five frequent terms: no proof above the last tier
    assert min(at[0], at[3]) < 3  # a proof by bounds
    assert sorted(repr((k, r, None if i == T._LAST else i, s)) for k, r, i, s in got) == brute(docs, list(enumerate(texts)))


def test_tiers_are_read_only_when_needed(spark):
    docs, _ = corpus(random.Random(7))
    df = spark.createDataFrame([(i or 0, t or "") for i, t in docs], "id long, text string")
    index = T.Index(df, {b"needle": 0})
    plan = index._tier(1)._jdf.queryExecution().executedPlan().toString()
    assert "impacts0" in plan and "impacts1" not in plan


def test_empty_tables(spark):
    docs, items = tables(spark, [], [(1, "a")])
    assert T.search(docs, items).count() == 0
    docs, items = tables(spark, [(1, "a b")], [])
    assert T.search(docs, items).count() == 0
    docs, items = tables(spark, [(1, None), (2, "!")], [(1, "a")])
    assert T.search(docs, items).count() == 0


def test_query_has_the_whole_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = queries.op12_tiered_search(spark, sf).collect()
    assert sorted(map(repr, map(tuple, got))) == brute(docs, items)
