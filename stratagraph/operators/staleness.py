"""Current against recorded hashes: differences, causes, orphans, moved documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_diff(current: DataFrame, stored: DataFrame, keys: list[str], value: str = "hash") -> DataFrame:
    """(keys, action): changed, added or removed between two (keys, value) tables."""
    now, old = current.select(*keys, F.col(value).alias("now"), F.lit(1).alias("n")), stored.select(*keys, F.col(value).alias("old"), F.lit(1).alias("o"))
    action = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("now").eqNullSafe(F.col("old")), "changed")
    return now.join(old, keys, "full_outer").withColumn("action", action).where("action IS NOT NULL").select(*keys, "action")


def unit_changes(now: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): ``action:source`` and ``action:dependencies`` of units whose source or dependency hash has moved."""
    pair = lambda df: df.select(*keys, F.explode(F.create_map(F.lit("source"), F.col("source_hash"), F.lit("dependencies"), F.col("deps_hash"))).alias("what", "hash"))
    return hash_diff(pair(now), pair(stored), [*keys, "what"]).select(*keys, F.concat_ws(":", "action", "what").alias("change"))


def upper_status(wanted: DataFrame, now: DataFrame, recorded: DataFrame, written: DataFrame) -> DataFrame:
    """wanted(doc_id, kind) with status: missing if never written, current while all recorded (doc_id, child_id, hash) are as they are now."""
    moved = hash_diff(now, recorded, ["doc_id", "child_id"]).groupBy("doc_id").agg(F.count("*").alias("moved"))
    rows = wanted.join(written.select("doc_id", F.lit(1).alias("written")), "doc_id", "left").join(moved, "doc_id", "left")
    return rows.select("doc_id", "kind", F.when(F.col("written").isNull(), "missing").when(F.col("moved").isNull(), "current").otherwise("stale").alias("status"))


def multiset_compare(now: DataFrame, old: DataFrame, group: str, value: str) -> DataFrame:
    """(group, outcome): equal, added (every old value is still there as often) or changed."""
    a = now.groupBy(group, value).agg(F.count("*").alias("n"))
    b = old.groupBy(group, value).agg(F.count("*").alias("o"))
    n, o = F.coalesce("n", F.lit(0)), F.coalesce("o", F.lit(0))
    kept = F.bool_and(n >= o)
    return a.join(b, [group, value], "full_outer").groupBy(group).agg(F.when(F.bool_and(n == o), "equal").when(kept, "added").otherwise("changed").alias("outcome"))


def orphans(documents: DataFrame, live: DataFrame, key: str) -> DataFrame:
    return documents.join(live.select(key), key, "left_anti")


def successors(old: DataFrame, live: DataFrame) -> DataFrame:
    """old(id, name, hash) to (id, successor, how): the one live row of the same hash.

    Rows of the same name come first; several that are left make no successor.
    """
    # Live rows are counted per hash, and per hash and name, before they meet: a common text costs one row, not its square.
    by_hash = live.groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("to"))
    by_name = live.where("name IS NOT NULL").groupBy("hash", "name").agg(F.count("*").alias("named"), F.min("id").alias("named_to"))
    met = old.select("id", "name", "hash").join(by_hash, "hash").join(by_name, ["hash", "name"], "left")
    n, to = F.coalesce("named", "n"), F.coalesce("named_to", "to")
    how = F.when(n > 1, "ambiguous").when(F.col("named").isNotNull(), "same_name").otherwise("renamed")
    return met.select("id", F.when(n == 1, to).alias("successor"), how.alias("how"))


def lineage_vote(resolved: DataFrame, old: str, new: str) -> DataFrame:
    """(old, winner): the new file with most successors of an old file; null on a tie."""
    votes = resolved.groupBy(old, new).agg(F.count("*").alias("votes"))
    best = votes.groupBy(old).agg(F.max("votes").alias("votes"))
    top = votes.join(best, [old, "votes"]).groupBy(old).agg(F.count("*").alias("leaders"), F.min(new).alias("leader"), F.max("votes").alias("votes"))
    return top.select(old, F.when(F.col("leaders") == 1, F.col("leader")).alias("winner"), "votes")


def claimed(successors_: DataFrame, key: str = "successor") -> DataFrame:
    """Successors that more than one row claims."""
    return successors_.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("claims")).where("claims > 1")


def cause_label(causes: DataFrame, key: str, cause: str) -> DataFrame:
    """(key, label): distinct cause kinds, sorted, joined by `` + ``."""
    return causes.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(cause)), " + ").alias("label"))


def reconcile(source_changed, human_edited):
    """What to do with a document: skip, regenerate, refresh its hashes, or regenerate from the edited text."""
    return (
        F.when(~source_changed & ~human_edited, "skip")
        .when(source_changed & ~human_edited, "regenerate")
        .when(~source_changed & human_edited, "refresh_hashes")
        .otherwise("regenerate_with_prior")
    )
