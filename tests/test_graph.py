import random

import pytest
from stratagraph.operators import graph as G


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def closure(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    far = {}
    for s in out:
        seen, front = set(), {s}
        while front:
            front = {n for x in front for n in out.get(x, ())} - seen
            seen |= front
        far[s] = seen
    return far


def brute_strong(pairs):
    far = closure(p for p in pairs if p[0] != p[1])
    own = {n: {m for m in far[n] if n in far.get(m, ())} for n in far}
    return sorted((n, min(m)) for n, m in own.items() if len(m) > 1)


def made(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize(("n", "m"), [(40, 30), (40, 60), (60, 70)])
def test_strong_components_equal_brute_force(spark, n, m):
    pairs = made(random.Random(n + m), n, m) + [(100 + k, 101 + k) for k in range(12)] + [(200, 201), (201, 202), (202, 200), (202, 203), (203, 204), (204, 203)]
    got = sorted(map(tuple, G.strong_components(edges_of(spark, pairs)).collect()))
    assert got == brute_strong(pairs)


def test_one_cycle_of_two_thousand_nodes(spark, monkeypatch):
    writes, write = [], G.observed
    monkeypatch.setattr(G, "observed", lambda df, **m: writes.append(1) or write(df, **m))
    n = 2000
    got = {tuple(r) for r in G.strong_components(edges_of(spark, [(k, (k + 1) % n) for k in range(n)] + [(n, 5), (7, n + 1)])).collect()}
    assert got == {(k, 0) for k in range(n)}
    assert len(writes) < 25  # rounds by the logarithm of its length


def test_no_edges(spark):
    none = edges_of(spark, [(1, 1)])
    assert G.strong_components(none).count() == 0
    assert G.distances(none).first().nodes == 0
    assert G.reach(none, none.selectExpr("a AS start")).count() == 0


def test_reach_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(G, "DEAL", 40)  # several parts and cells
    pairs = made(random.Random(8), 150, 260)
    far = closure(pairs)
    edges = edges_of(spark, pairs)
    got = sorted(map(tuple, G.reach(edges, edges.selectExpr("a AS start")).collect()))
    assert got == sorted((s, n) for s, seen in far.items() for n in seen if n != s)
    one = sorted(map(tuple, G.reach(edges, edges.selectExpr("a AS start"), depth=1).collect()))
    assert one == sorted({p for p in pairs if p[0] != p[1]})


def test_a_level_is_a_row_a_node_and_cell(spark):
    """A complete layered graph: 120 starts, all of which reach all below."""
    pairs = [(a, 1000 + k) for a in range(120) for k in range(5)] + [(1000 + k, 2000 + j) for k in range(5) for j in range(5)]
    edges = edges_of(spark, pairs)
    codes = G.coded(edges.where("a < 1000").selectExpr("a AS start"))
    hops = G._hops(edges, "a", "b")
    levels = list(G.packed_levels(hops, G._seeds(codes, codes.selectExpr("start", "start AS node"))))
    assert [n for _, _, n in levels] == [0, 600, 600]
    assert levels[-1][1].count() == 120 + 10 * codes.select("cell").distinct().count()


def test_distances_of_the_largest_component(spark):
    chain = [(k, k + 1) for k in range(5)]
    row = G.distances(edges_of(spark, chain + [(100, 101), (101, 102), (7, 7)])).first()
    far = [abs(x - y) for x in range(6) for y in range(6) if x != y]
    assert (row.nodes, row.diameter) == (6, 5) and row.mean_distance == pytest.approx(sum(far) / len(far))


def test_participants_masks(spark):
    entries = spark.createDataFrame([("e1", "f1"), ("e2", "f2")], "entry string, file string")
    edges = spark.createDataFrame([("f1", "f3", "f3::x"), ("f2", "f3", "f3::x"), ("f3", "f4", "f4::y"), ("f4", "f5", None), ("f1", "db", "db::t")], "from_file string, target_file string, target string")
    admitted = spark.createDataFrame([(None, "f3"), ("e1", "f4"), (None, "db")], "entry string, file string")
    symbols = spark.createDataFrame([("f3::x", "f3", "callable"), ("f4::y", "f4", "callable"), ("db::t", "db", "schema")], "id string, file string, kind string")
    got = sorted(map(tuple, G.participants(entries, edges, admitted, symbols).collect()))
    assert got == [("e1", "core", "f1"), ("e1", "core", "f3"), ("e1", "core", "f4"), ("e1", "data", "db::t"), ("e2", "core", "f2"), ("e2", "core", "f3"), ("e2", "dependencies", "f4::y")]


def test_rounds_over_larger_tables_broadcast_none(spark, monkeypatch):
    """Small files of many rows: what a round broadcasts goes through the driver every round."""
    from stratagraph import staging

    assert staging.staying(spark.range(9), staging.SENT)._jdf.queryExecution().analyzed().toString().count("ResolvedHint") == 0
    monkeypatch.setattr(staging, "SENT", 0)
    plans, write = [], staging.checkpointed
    monkeypatch.setattr(staging, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    pairs = made(random.Random(5), 80, 90)
    edges = edges_of(spark, pairs)
    assert sorted(map(tuple, G.strong_components(edges).collect())) == brute_strong(pairs)
    low = {}
    for a, b in pairs:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in low:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert sorted(map(tuple, G.components(edges).collect())) == sorted(low.items())
    far = closure(pairs)
    assert G.reach(edges, edges.selectExpr("a AS start")).count() == sum(n != s for s, seen in far.items() for n in seen)
    assert len(plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)
