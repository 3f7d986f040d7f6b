"""Hashes of a group's lines in order, over chunks of a fixed number, so that no task holds a large group.

A group of at most ``fan`` lines is hashed as one text. A larger one is cut into chunks of ``fan`` lines in order; the
hashes of the chunks are its lines one level up, and so on until at most ``fan`` are left. Where a line stands in its
group is counted over ranges, which split a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions.hashing import stable
from stratagraph.operators.ordered import before, dealt
from stratagraph.staging import checkpointed

FAN = 1024


def _text(order: list[str]) -> Column:
    """Aggregate: the lines in order, as an array of at most ``fan``."""
    return F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col("_line").alias("line")))), lambda r: r.line)


def hashed_lines(rows: DataFrame, key: str, order: list[str], line: Column, into: str, head: Column | None = None, fan: int = FAN) -> DataFrame:
    """(key, into): one hash of each key's lines, by ``order`` and then by the line itself.

    ``head``, an expression over the key, is the first line of the last level. A null line is no line; a key with
    none but such has the hash of its head. A null key is a key. No rows give none.
    """
    by = [*(f"_o{i}" for i in range(len(order))), "_line"]
    own = rows.select(F.col(key), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], line.alias("_line"))
    last = lambda lines, at: lines.groupBy(key).agg(_text(at).alias("_text")).select(key, stable(F.concat_ws("\n", *([] if head is None else [head]), "_text")).alias(into))
    large = checkpointed(own.groupBy(key).agg(F.count("_line").alias("_n")).where(F.col("_n") > fan))
    most = large.agg(F.max("_n")).first()[0] or 0
    if not most:
        return last(own, by[:-1])
    sizes = large.select(F.col(key).alias("_of"), "_n")
    same = F.col(key).eqNullSafe(F.col("_of"))
    out = last(own.join(sizes, same, "left_anti"), by[:-1])
    long = own.where(F.col("_line").isNotNull()).join(sizes, same).drop("_of").withColumn("_one", F.lit(1))
    placed = before(dealt(long, key, by), key, by, "_one", "_place")
    level = placed.select(key, F.coalesce("_place", F.lit(0)).alias("_at"), "_n", "_line")
    while most > fan:
        chunks = level.groupBy(key, "_n", F.expr(f"_at div {fan}").alias("_up")).agg(stable(F.concat_ws("\n", _text(["_at"]))).alias("_line"))
        most = -(-most // fan)
        level = checkpointed(chunks.select(key, F.col("_up").alias("_at"), F.expr(f"(_n + {fan - 1}) div {fan}").alias("_n"), "_line"))
        out = out.unionByName(last(level.where(F.col("_n") <= fan), ["_at"]))
        level = level.where(F.col("_n") > fan)
    return out
