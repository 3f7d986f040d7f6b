import random

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import ordered
from stratagraph.operators import reports as R
from stratagraph.operators import search as S


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_before_equals_plain_loop(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(10**6), rng.choice([None, 1, 2, 70]), i) for i in range(600)]
    df = ordered.dealt(spark.createDataFrame(rows, "k string, o int, v int, i int"), "k", ["o"], ranges)
    sums = {r.i: r.s for r in ordered.before(df, "k", ["o"], "v", "s").collect()}
    tops = {r.i: r.s for r in ordered.before(df, "k", ["o"], "v", "s", largest=True).collect()}
    assert len(sums) == len(tops) == len(rows)
    for k, o, _, i in rows:
        past = [v for k2, o2, v, _ in rows if k2 == k and o2 < o and v is not None]
        assert sums[i] == (sum(past) if past else None) and tops[i] == max(past, default=None)


def test_equal_rows_are_spread(spark):
    df = ordered.dealt(spark.range(100_000).select(F.lit("k").alias("k"), F.lit(1).alias("o"), F.lit(1).alias("v")), "k", ["o"], 8)
    assert df.groupBy("_range").count().agg(F.max("count")).first()[0] < 30_000
    got = ordered.before(df, "k", ["o"], "v", "n").agg(F.count_distinct("n"), F.max("n"), F.sum(F.col("n").isNull().cast("int"))).first()
    assert tuple(got) == (99_999, 99_999, 1)


def test_islands_over_ranges(spark, monkeypatch):
    whole = ordered.dealt
    monkeypatch.setattr(ordered, "dealt", lambda rows, key, order: whole(rows, key, order, 7))
    rng = random.Random(4)
    spans = [("hot" if rng.random() < 0.7 else rng.choice("ab"), a := rng.randrange(3000), a + rng.randrange(12)) for _ in range(500)]
    want = []
    for k in sorted({s[0] for s in spans}):
        merged = []
        for a, b in sorted((a, b) for k2, a, b in spans if k2 == k):
            if merged and a <= merged[-1][1] + 2:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(k, a, b) for a, b in merged]
    got = S.merge_spans(spark.createDataFrame(spans, "k string, start int, end int"), "k").collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("ranges,n", [(1, 2), (3, 2), (40, 3), (40, 1)])
def test_neighbours_over_ranges(spark, monkeypatch, ranges, n):
    whole = ordered.dealt
    monkeypatch.setattr(ordered, "dealt", lambda rows, key, order: whole(rows, key, order, ranges))
    rng = random.Random(n)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), o, rng.choice([None, o, o])) for o in rng.sample(range(10**6), 300)]
    got = {r.o: (r.before, r.after) for r in S.context(spark.createDataFrame(rows, "k string, o int, v int"), "k", "o", "v", n).collect()}
    assert len(got) == len(rows)
    for key in {k for k, _, _ in rows}:
        own = sorted((o, v) for k, o, v in rows if k == key)
        for i, (o, _) in enumerate(own):
            want = [[v for _, v in part if v is not None] for part in (own[max(0, i - n) : i], own[i + 1 : i + 1 + n])]
            assert [list(x) for x in got[o]] == want


def test_numbers_of_one_key_and_of_ties(spark, monkeypatch):
    whole = ordered.dealt
    monkeypatch.setattr(ordered, "dealt", lambda rows, key, order: whole(rows, key, order, 9))
    rows = spark.range(5000).select(F.lit("k").alias("k"), (F.col("id") % 7).alias("o"), "id")
    got = sorted((r.ord, r.o) for r in R.edge_order(rows, "k", ["o"]).collect())
    assert [g[0] for g in got] == list(range(1, 5001)) and [g[1] for g in got] == sorted(g[1] for g in got)
    heads = spark.createDataFrame([(1, 1, "A b"), (1, 2, "a-B"), (1, 3, "A  B"), (2, 1, "a b"), (None, 1, "x"), (None, 2, "x")], "k int, o int, h string")
    assert sorted(((r.k or 0), r.o, r.anchor) for r in R.anchors(heads, "k", "o", F.col("h")).collect()) == [(0, 1, "x"), (0, 2, "x-1"), (1, 1, "a-b"), (1, 2, "ab"), (1, 3, "a-b-1"), (2, 1, "a-b")]


def test_empty_and_null(spark):
    nothing = spark.createDataFrame([], "k string, o int, v int")
    assert S.context(nothing, "k", "o", "v", 2).count() == 0 == R.edge_order(nothing, "k", ["o"]).count()
    assert [list(r.before) for r in S.context(spark.createDataFrame([("k", 1, 5)], "k string, o int, v int"), "k", "o", "v", 0).collect()] == [[]]
    empty = spark.createDataFrame([], "k string, o int, size int")
    assert S.byte_budget(empty, "k", ["o"], "size", 5).count() == 0 == S.number_repeats(empty, "k", ["o"], "-").count()
    rows = spark.createDataFrame([(None, 1, 3), (None, 2, None), (None, 3, 3), (None, 4, 1)], "k string, o int, size int")
    assert sorted(r.o for r in S.byte_budget(rows, "k", ["o"], "size", 5).collect()) == [1, 2, 3]
    assert [r.k for r in S.number_repeats(rows, "k", ["o"], "-").collect()] == [None] * 4
