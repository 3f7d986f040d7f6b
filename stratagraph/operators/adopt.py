"""Moved documents: which orphans have a successor, what to do with each, and links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import staleness as S


def plan(old: DataFrame, live: DataFrame) -> DataFrame:
    """old and live (id, file, name, hash) to (id, file, successor, disposition).

    Equal hashes give a successor; a tie within the new file that most of an old file's other
    entries moved to is settled by that vote; successors that several claim are refused.
    """
    found = S.successors(old.select("id", "name", "hash"), live.select("id", "name", "hash"))
    to_file = live.select(F.col("id").alias("successor"), F.col("file").alias("new_file"))
    votes = S.lineage_vote(found.where("successor IS NOT NULL").join(to_file, "successor").join(old.select("id", F.col("file").alias("old_file")), "id"), "old_file", "new_file")
    rows = old.select("id", "file", "hash", "name").join(found, "id", "left").join(votes.select(F.col("old_file").alias("file"), "winner"), "file", "left")
    inside = live.select(F.col("file").alias("winner"), "name", "hash", F.col("id").alias("near"))
    near = rows.where("successor IS NULL AND winner IS NOT NULL").join(inside, ["winner", "name", "hash"]).groupBy("id").agg(F.count("*").alias("n"), F.min("near").alias("near")).where("n = 1").select("id", "near")
    rows = rows.join(near, "id", "left").withColumn("successor", F.coalesce("successor", "near"))
    claims = S.claimed(rows).select("successor", F.lit(1).alias("taken"))
    rows = rows.join(claims, "successor", "left")
    what = F.when(F.col("successor").isNull() & (F.col("how") == "ambiguous"), "ambiguous").when(F.col("successor").isNull(), "gone").when(F.col("taken") == 1, "claimed").otherwise("adopt")
    return rows.select("id", "file", "successor", what.alias("disposition"))


def vanished_names(prose: DataFrame, live: DataFrame, orphaned: DataFrame) -> DataFrame:
    """(id, name): file-like names in prose that end no live path but an orphaned one."""
    from stratagraph.operators.resolve import suffixes

    names = prose.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([\w./-]+\.[a-z]{1,4})\b"), F.lit(1)))).alias("name"))
    ends = lambda df: df.select(F.explode(suffixes(F.col("file"))).alias("name")).distinct()
    return names.join(ends(live), "name", "left_anti").join(ends(orphaned), "name", "left_semi").select("id", "name")


def sweep(base: DataFrame, head: DataFrame) -> DataFrame:
    """What two builds disagree on: rows of one only, with the side."""
    only = lambda a, b, side: a.exceptAll(b).withColumn("side", F.lit(side))
    return only(base, head, "base").unionByName(only(head, base, "head"))
