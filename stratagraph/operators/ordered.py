"""Sums, maxima and neighbours of a row within its key, with no task that holds a whole key.

Rows are dealt by range of (key, order), equal rows at random, and staged, so that a range is fixed. Inside a
range a window gives what comes before; a key that began in an earlier range adds one total for the ranges
before. A range continues at most one key, so there is at most one such total a range. Neighbours are halo rows:
each range hands its first and last values of a key to the ranges that the key goes on in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.staging import checkpointed

#: Columns that ``dealt`` adds: the range, and the place among rows equal in key and order.
ADDED = ("_range", "_tie")


def dealt(rows: DataFrame, key: str, order: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with their range, staged."""
    by = [key, *order, "_tie"]
    tied = rows.withColumn("_tie", F.rand(7))
    spread = tied.repartitionByRange(ranges, *by) if ranges else tied.repartitionByRange(*by)
    return checkpointed(spread.withColumn("_range", F.spark_partition_id()))


def before(rows: DataFrame, key: str, order: list[str], value: str, into: str, largest: bool = False) -> DataFrame:
    """``into``: the sum (or largest) of ``value`` over the earlier rows of the key; null for the first."""
    total = F.max if largest else F.sum
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = rows.groupBy("_range", key).agg(total(value).alias("_own"))
    sums = own.select(F.col("_range").alias("_at"), F.col(key).alias("_of"), total("_own").over(earlier(Window.partitionBy(key).orderBy("_range"))).alias("_past"))
    inside = rows.withColumn("_inside", total(value).over(earlier(Window.partitionBy("_range", key).orderBy(*order, "_tie"))))
    # At most one row a range, whatever the number of rows.
    met = inside.join(F.broadcast(sums.where(F.col("_past").isNotNull())), (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_of")), "left")
    both = F.greatest("_inside", "_past") if largest else F.coalesce(F.col("_inside") + F.col("_past"), "_inside", "_past")
    return met.withColumn(into, both).drop("_inside", "_at", "_of", "_past")


def numbered(rows: DataFrame, key: str, order: list[str], into: str) -> DataFrame:
    """``into``: the place of a row within its key, from 1; equal rows in any order, but one."""
    counted = before(dealt(rows.withColumn("_one", F.lit(1).cast("long")), key, order), key, order, "_one", "_before")
    return counted.withColumn(into, F.coalesce("_before", F.lit(0)) + 1).drop(*ADDED, "_one", "_before")


def neighbours(rows: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Rows with ``before`` and ``after``: the values of up to ``n`` rows of the key on either side, in order.

    Null values are left out but take a place. Rows of a null key are each other's neighbours.
    """
    if n <= 0:
        none = F.array().cast(f"array<{rows.schema[value].dataType.simpleString()}>")
        return rows.withColumn("before", none).withColumn("after", none)
    w = Window.partitionBy("_range", key).orderBy(*order, "_tie")
    held = F.collect_list(F.struct(F.col(value).alias("v")))  # a struct, so that a null keeps its place
    inside = dealt(rows, key, order).withColumn("_b", held.over(w.rowsBetween(-n, -1))).withColumn("_a", held.over(w.rowsBetween(1, n)))
    own = F.array_sort(F.collect_list(F.when(F.size("_b") < n, F.struct(F.size("_b").alias("i"), F.col(value).alias("v")))))
    last = F.array_sort(F.collect_list(F.when(F.size("_a") < n, F.struct((-F.size("_a")).alias("i"), F.col(value).alias("v")))))
    plain = lambda c: F.transform(c, lambda r: F.struct(r.v.alias("v")))
    edges = inside.groupBy("_range", key).agg(plain(own).alias("_first"), plain(last).alias("_last"))
    by = Window.partitionBy(key).orderBy("_range")  # a row a range at most
    past = F.flatten(F.collect_list("_last").over(by.rowsBetween(-n, -1)))  # a range holds one row of the key at least
    next_ = F.flatten(F.collect_list("_first").over(by.rowsBetween(1, n)))
    halo = edges.select(F.col("_range").alias("_at"), F.col(key).alias("_of"), past.alias("_past"), next_.alias("_next")).where(F.size("_past") + F.size("_next") > 0)
    # A range shares a key with those beside it at its two ends only: two rows a range at most, of 2 n^2 values.
    met = inside.join(F.broadcast(halo), (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_of")), "left")
    none = F.array().cast(inside.schema["_b"].dataType)
    back = F.concat(F.coalesce("_past", none), "_b")
    back = F.slice(back, F.greatest(F.size(back) - n + 1, F.lit(1)), n)
    ahead = F.slice(F.concat("_a", F.coalesce("_next", none)), 1, n)
    values = lambda c: F.transform(F.filter(c, lambda r: r.v.isNotNull()), lambda r: r.v)
    return met.withColumn("before", values(back)).withColumn("after", values(ahead)).drop(*ADDED, "_b", "_a", "_at", "_of", "_past", "_next")


def islands(rows: DataFrame, key: str, order: list[str], start: str, end: str, fresh) -> DataFrame:
    """Rows with ``_island``, raised by one at each row whose ``fresh(start, largest end before)`` holds."""
    seen = before(dealt(rows, key, order), key, order, end, "_last", largest=True)
    marked = seen.withColumn("_new", (F.col("_last").isNull() | fresh(F.col(start), F.col("_last"))).cast("int"))
    counted = before(marked, key, order, "_new", "_so_far")
    return counted.withColumn("_island", F.coalesce("_so_far", F.lit(0)) + F.coalesce("_new", F.lit(0))).drop(*ADDED, "_last", "_new", "_so_far")
