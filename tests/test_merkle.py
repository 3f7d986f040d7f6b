import hashlib
import random

from pyspark.sql import functions as F

from stratagraph.operators.merkle import hashed_lines


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _plain(lines, head, fan):
    while len(lines) > fan:
        lines = [_sha("\n".join(lines[i : i + fan])) for i in range(0, len(lines), fan)]
    return _sha("\n".join(([] if head is None else [head]) + lines))


def _want(rows, fan, headed):
    keys = {k for k, _, _ in rows}
    return {k: _plain([x for _, x in sorted((o, x) for k2, o, x in rows if k2 == k and x is not None)], ("" if k is None else f"key {k}") if headed else None, fan) for k in keys}


def test_levels_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 12 + ["a", "b", "c", None]), rng.randrange(200), rng.choice([None, "x", "y", f"l{i}"])) for i in range(700)]
    rows += [("few", i, f"f{i}") for i in range(4)] + [("five", i, f"f{i}") for i in range(5)] + [("none", 1, None)]
    df = spark.createDataFrame(rows, "k string, o int, x string")
    for fan in (4, 7, 1024):
        got = hashed_lines(df, "k", ["o"], F.col("x"), "hash", F.coalesce(F.concat(F.lit("key "), "k"), F.lit("")), fan)
        assert {r.k: r.hash for r in got.collect()} == _want(rows, fan, True)
        assert {r.k: r.hash for r in hashed_lines(df, "k", ["o"], F.col("x"), "hash", fan=fan).collect()} == _want(rows, fan, False)


def test_no_rows(spark):
    assert hashed_lines(spark.createDataFrame([], "k string, o int, x string"), "k", ["o"], F.col("x"), "hash").collect() == []


def test_one_group_of_many(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("o"), F.col("id").cast("string").alias("x"))
    got = hashed_lines(df.repartition(13), "k", ["o"], F.col("x"), "hash").collect()
    assert [r.hash for r in got] == [_plain([str(i) for i in range(n)], None, 1024)]
