import random

import pytest
from stratagraph import staging
from stratagraph.operators import graph, intervals, reachability
from test_graph import closure, edges_of, made


@pytest.mark.parametrize("kind", [reachability.Closure, reachability.Index])
@pytest.mark.parametrize(("n", "m"), [(60, 75), (40, 90)])
def test_pairs_equal_the_closure(spark, kind, n, m):
    rng = random.Random(n)
    pairs = made(rng, n, m)
    far = closure(pairs)
    asked = [(a, b) for a in range(n + 3) for b in range(n + 3)]
    got = sorted(map(tuple, kind(edges_of(spark, pairs)).among(spark.createDataFrame(asked + asked[:9], "f long, h long"), "f", "h").collect()))
    assert got == [(a, b) for a, b in asked if a != b and b in far.get(a, ())]


def test_no_table_grows_as_the_closure(spark, monkeypatch):
    """Ten full layers of twenty: 18,000 pairs reach each other over 3,600 edges."""
    rows, plain, watched = [], reachability.checkpointed, reachability.observed

    def kept(df):
        out = plain(df)
        rows.append(out.count())
        return out

    def seen(df, **m):
        out = watched(df, **m)
        rows.append(out[0].count())
        return out

    for module in (reachability, graph, intervals):
        monkeypatch.setattr(module, "checkpointed", kept)
        monkeypatch.setattr(module, "observed", seen)
    pairs = [(20 * k + i, 20 * k + 20 + j) for k in range(9) for i in range(20) for j in range(20)]
    index = reachability.Index(edges_of(spark, pairs))
    asked = [(i, 180 + i) for i in range(20)] + [(180 + i, i) for i in range(20)] + [(0, 1)]
    got = sorted(map(tuple, index.among(spark.createDataFrame(asked, "a long, b long"), "a", "b").collect()))
    assert got == asked[:20]
    assert max(rows) <= len(pairs)


def test_over_chooses_by_size(spark):
    edges = edges_of(spark, [(1, 2), (2, 3)])
    assert isinstance(reachability.over(edges), reachability.Closure)
    index = reachability.over(edges, small=2)
    assert isinstance(index, reachability.Index)
    assert [tuple(r) for r in index.among(spark.createDataFrame([(1, 3), (3, 1)], "x long, y long"), "x", "y").collect()] == [(1, 3)]


@pytest.mark.parametrize("sent", [1 << 15, 6, 0])
def test_rounds_write_what_has_moved(spark, monkeypatch, sent):
    """A chain of nine beside forty pairs: after the first rounds one node moves a round."""
    wrote, watched = [], reachability.observed

    def seen(df, **m):
        out = watched(df, **m)
        wrote.append(out[0].count())
        return out

    monkeypatch.setattr(reachability, "observed", seen)
    monkeypatch.setattr(staging, "SENT", sent)
    monkeypatch.setattr(reachability, "SENT", sent, raising=False)
    pairs = [(i, i + 1) for i in range(8)] + [(100 + i, 200 + i) for i in range(40)]
    index = reachability.Index(edges_of(spark, pairs), forests=1)
    index.edges = edges_of(spark, pairs)
    ids = sorted({x for p in pairs for x in p})
    labels = spark.createDataFrame([(i, i, i, i, i) for i in ids], "id long, enter0 long, leave0 long, low0 long, high0 long")
    got = {r.id: (r.low0, r.high0) for r in index._spread(labels).collect()}
    assert got == {i: (i, 8 if i < 9 else i + 100 if i < 200 else i) for i in ids}
    assert sent < 1 << 15 or sum(wrote) <= 4 * len(ids)  # before, every round wrote all nodes
