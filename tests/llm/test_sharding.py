import random
import zlib
from collections import defaultdict
from itertools import accumulate

import pytest

from stratagraph.llm import sharding as S


class F:
    @staticmethod
    def signed_hash(text):  # Spark's xxhash64 of a string
        import xxhash

        h = xxhash.xxh64_intdigest(text.encode(), 42)
        return h - (1 << 64) if h >> 63 else h


def test_large_groups_leave_no_shard_empty():
    rng = random.Random(9)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 3, 8]) for _ in range(rng.randrange(50, 300))]
        for _ in range(rng.randrange(4)):
            sizes.insert(rng.randrange(len(sizes) + 1), rng.choice([20, 300, 900]))
        shards = rng.choice([2, 7, 40])
        cells = [(i, 64, n, 1) for i, n in enumerate(sizes)]
        capacity = S.smallest_capacity(sizes, shards)
        ends = S.level(cells, shards, capacity)
        parts = [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)]
        assert ends[-1] == len(sizes) and len(ends) == shards and max(parts) == capacity
        assert min(parts) > 0
        large = {n for n in sizes if n > sum(sizes) / shards}
        rest = sorted(p for p in parts if p not in large)
        assert not large or shards < 40 or rest[-1] <= 3 * max(1, rest[0]) + 28


def test_repeats_spread(spark):
    from pyspark.sql import functions as G

    df = spark.range(100_000).select(G.lit(7).cast("long").alias("doc_id"), G.lit("equal rows").alias("text"))
    got = S.shard(df)
    assert got.select("shard").distinct().count() == 1 and got.select("slot").distinct().count() == 100_000
    assert got.agg(G.max("slot"), G.min("slot")).first()[:] == (99_999, 0)


def brute_capacity(sizes, shards):
    for capacity in range(max([0, *sizes]), sum(sizes) + 1):
        used, room = 1, capacity
        for x in sizes:
            if x > room:
                used, room = used + 1, capacity
            room -= x
        if used <= shards:
            return capacity
    return 0


@pytest.mark.parametrize("seed", range(8))
def test_smallest_capacity(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 16, 40, 90]) for _ in range(rng.randrange(1, 60))]
    for shards in (1, 2, 3, 7, 80):
        capacity = S.smallest_capacity(sizes, shards)
        assert capacity == brute_capacity(sizes, shards)
        ends = S.greedy([0, *accumulate(sizes)], shards, capacity)
        assert max(sum(sizes[a:b]) for a, b in zip([0, *ends], ends)) <= capacity


@pytest.mark.parametrize(("top", "cells", "shards"), [(3, 4, 5), (14, 1024, 7), (1, 64, 40)])
def test_cells_find_the_exact_capacity(spark, monkeypatch, top, cells, shards):
    monkeypatch.setattr(S, "TOP_BITS", top)
    monkeypatch.setattr(S, "MAX_CELLS", cells)
    rng = random.Random(top)
    groups = sorted((rng.getrandbits(64) - (1 << 63), rng.choice([16, 30, 77, 500, 3000])) for _ in range(400))
    df = spark.createDataFrame(groups, "h long, size long")
    capacity, starts = S.bounds(df, shards)
    sizes = [s for _, s in groups]
    assert capacity == S.smallest_capacity(sizes, shards)
    totals = defaultdict(int)
    for h, size in groups:
        totals[sum(h >= s for s in starts)] += size
    assert max(totals.values()) == capacity and len(totals) <= shards


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got, texts = S.shard(docs).collect(), {r.doc_id: r.text for r in docs.collect()}
    slots, sizes, of_text = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "bytes")
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        of_text[texts[r.doc_id]].add(r.shard)
    assert len(got) == len(texts) and set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    groups = defaultdict(int)
    for r in got:
        groups[texts[r.doc_id]] += r.size
    of = {t: F.signed_hash(t) for t in groups}
    in_order = [groups[t] for t in sorted(groups, key=of.get)]
    assert max(sizes.values()) == S.smallest_capacity(in_order, 40)  # the exact minimax of the query's own groups
    assert len(sizes) == min(40, len(groups))


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 3), (None, "", 3), (2, "a" * 1000, 3)] + [(3, "same", 3)] * 50, "doc_id long, text string, shard int")
    got = S.shard(df).collect()
    assert len(got) == 53 and len({r.shard for r in got if r.size == 16}) == 1
    assert sorted(r.size for r in got)[:2] == [16, 16]
    hot = [r for r in got if r.size == 20]
    assert len(hot) == 50 and len({r.shard for r in hot}) == 1 and len({(r.shard, r.slot) for r in got}) == 53
    assert S.shard(df.limit(0)).count() == 0


def test_very_long_texts(spark):
    rows = [(i, "é" * (400_000 if i == 7 else 50)) for i in range(30)] + [(40, "é" * 400_000)]
    got = S.shard(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert sum(r.size for r in got) == sum(2 * len(t) + 16 for _, t in rows)
    assert len({r.shard for r in got if r.size > 1000}) == 1 and sum(r.size > 1000 for r in got) == 2
