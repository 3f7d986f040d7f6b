import random
import re

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import ordered, reports
from stratagraph.operators.resolve import route_join

RANKS = {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_ranks_equal_sorted_lists(spark, monkeypatch, ranges):
    whole = ordered.dealt
    monkeypatch.setattr(reports, "dealt", lambda rows, key, order: whole(rows, key, order, ranges))
    rng = random.Random(ranges)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.choice([None, 1.5, 1.5, rng.random()])) for _ in range(900)] + [("one", 3.0), ("none", None)]
    got = reports.nearest_ranks(spark.createDataFrame(rows, "k string, v double"), "k", "v", RANKS)
    seen = {r.k: tuple(r[p] for p in RANKS) for r in got.collect()}
    lists = {k: sorted(v for k2, v in rows if k2 == k and v is not None) for k in {k for k, _ in rows}}
    assert seen == {k: tuple(x[int((len(x) - 1) * p + 0.5)] for p in RANKS.values()) for k, x in lists.items() if x}
    assert reports.nearest_ranks(spark.createDataFrame([], "k string, v double"), "k", "v", RANKS).collect() == []


def _matches(path, pattern):
    a, b = ([x for x in s.split("/") if x] for s in (path, pattern))
    return len(a) == len(b) and all(x == y or re.fullmatch(r"\[.*\]", y) for x, y in zip(a, b, strict=True))


def test_routes_with_open_parts_anywhere(spark):
    rng = random.Random(3)
    path = lambda p: "/" + "/".join("[x]" if rng.random() < p else rng.choice("abcd") for _ in range(rng.randrange(5)))
    paths = [path(0) for _ in range(300)] + [None, "", "a//b/", "/[x]/a"]
    routes = sorted({(path(0.6), rng.randrange(4)) for _ in range(60)} | {(None, 0)}, key=str)
    found = route_join(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(routes, "pattern string, ord int"))
    want = {}
    for p in paths:
        met = sorted((o, r) for r, o in routes if p is not None and r is not None and _matches(p, r))
        if met:
            want[p] = met[0][1]
    assert {r.path: r.pattern for r in found.collect()} == want


def test_open_first_parts_meet_by_equality(spark):
    """Thousands of routes that begin with an open part: every join is by equality and no path meets them all."""
    routes = spark.range(3000).select(F.concat(F.lit("/[x]/r"), "id").alias("pattern"), F.lit(0).alias("ord"))
    paths = spark.range(3000).select(F.concat(F.lit("/p/r"), "id").alias("path"))
    found = route_join(paths, routes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.where("substring(path, 4) = substring(pattern, 6)").count() == found.count() == 3000
