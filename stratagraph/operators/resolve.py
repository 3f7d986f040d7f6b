"""Resolution joins: specifier to target by path suffix, by pattern, by priority, by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffixes(path: Column) -> Column:
    """Every path suffix that starts at a part: a/b/c, b/c, c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def suffix_join(wanted: DataFrame, files: DataFrame, suffix: str = "suffix", path: str = "path") -> DataFrame:
    """(wanted, target): the smallest file path that ends with the wanted parts. Files explode once, then an equi join."""
    known = files.select(F.col(path).alias("target"), F.explode(suffixes(F.col(path))).alias(suffix)).groupBy(suffix).agg(F.min("target").alias("target"))
    return wanted.join(known, suffix, "left")


def unique_suffix(files: DataFrame, path: str = "path") -> DataFrame:
    """(suffix, target) for suffixes that only one file has."""
    return files.select(F.col(path).alias("target"), F.explode(suffixes(F.col(path))).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")


def first_match(candidates: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The value of the best candidate per key, as a min aggregate (no sort of the candidates)."""
    return candidates.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(value))


def route_join(literals: DataFrame, routes: DataFrame, path: str = "path", pattern: str = "pattern", order: str = "ord") -> DataFrame:
    """(literal, route): parts are equal one by one, ``[x]`` matches any, the first route wins. A null meets nothing.

    Routes fall into shapes: how many parts they have, and which of them are fixed. A path asks each shape of its
    length for the route with its own parts there, so that joins are by equality, wherever the open parts are.
    """
    part = lambda c: F.filter(F.split(c, "/"), lambda x: x != "")
    held = lambda parts: F.array_join(F.transform("fixed", lambda i: F.get(parts, i)), "/")  # noqa: E731  (no part holds a slash)
    lit = literals.select(path).where(F.col(path).isNotNull()).distinct().withColumn("parts", part(F.col(path)))
    pat = routes.select(pattern, order, part(F.col(pattern)).alias("wanted")).where(F.col(pattern).isNotNull())
    places = F.filter(F.transform("wanted", lambda x, i: F.when(~x.rlike(r"^\[.*\]$"), i)), lambda i: i.isNotNull())
    shaped = pat.select(pattern, order, F.size("wanted").alias("n"), places.alias("fixed"), "wanted").withColumn("held", held("wanted"))
    first = shaped.groupBy("n", "fixed", "held").agg(F.min(F.struct(order, pattern)).alias("r"))
    asking = lit.withColumn("n", F.size("parts")).join(first.select("n", "fixed").distinct(), "n").withColumn("held", held("parts"))
    return asking.join(first, ["n", "fixed", "held"]).groupBy(path).agg(F.min("r").alias("r")).select(path, F.col(f"r.{pattern}").alias(pattern))


def coalesce_join(names: DataFrame, tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """Left joins in order of preference; the first that has the name gives the value. Tables have unique keys."""
    out = names
    for i, t in enumerate(tables):
        out = out.join(t.select(key, F.col(value).alias(f"_{i}")), key, "left")
    return out.withColumn(value, F.coalesce(*[f"_{i}" for i in range(len(tables))])).drop(*[f"_{i}" for i in range(len(tables))])


def reexport_chase(imports: DataFrame, declared: DataFrame, reexports: DataFrame, hops: int) -> DataFrame:
    """imports(file, name, ...) whose (file, name) is declared, or re-exported at most ``hops`` times on the way.

    declared(file, name, id); reexports(file, name, to_file, to_name).
    """
    keys = [c for c in imports.columns if c not in ("file", "name")]
    left, found = imports, None
    for hop in range(hops + 1):
        met = left.join(declared, ["file", "name"], "left")
        hit = met.where("id IS NOT NULL").select(*keys, "id")
        found = hit if found is None else found.unionByName(hit)
        if hop < hops:
            left = met.where("id IS NULL").drop("id").join(reexports, ["file", "name"]).select(*keys, F.col("to_file").alias("file"), F.col("to_name").alias("name"))
    return found


def word_join(reach: DataFrame, offered: DataFrame, words: DataFrame) -> DataFrame:
    """Edges from a file to the symbols that a reached header offers and the file writes: two equi joins."""
    return reach.join(offered, "header").join(words.withColumnRenamed("word", "name"), ["file", "name"], "left_semi")


def words_written(reach: DataFrame, offered: DataFrame) -> DataFrame:
    """The same where each reached row carries its file's words as an array: one equi join on the header, no word is shuffled."""
    return reach.join(offered, "header").where(F.array_contains("words", F.col("name")))


def scoped_by_words(imports: DataFrame, name: str, words: str, target: str, itself: Column) -> DataFrame:
    """Imports whose name the words beside them hold, without those that lead to the part itself."""
    return imports.where(F.array_contains(words, F.col(name)) & ~F.col(target).eqNullSafe(itself))


def unique_shallowest(candidates: DataFrame, key: str, depth: str, value: str) -> DataFrame:
    """(key, value) where the smallest depth has one candidate only."""
    at_depth = candidates.groupBy(key, depth).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    best = at_depth.groupBy(key).agg(F.min_by(F.struct("_low", "_high"), depth).alias("b"))
    return best.where("b._low = b._high").select(key, F.col("b._low").alias(value))


def accuracy(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Counts for recall and precision of an edge set against the true one."""
    a, b = found.select(*keys).distinct().withColumn("f", F.lit(1)), truth.select(*keys).distinct().withColumn("t", F.lit(1))
    both = a.join(b, keys, "full_outer").agg(F.count("f").alias("found"), F.count("t").alias("truth"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("both"))
    rate = lambda part: F.when(F.col(part) == 0, 1.0).otherwise(F.col("both") / F.col(part))
    return both.select("found", "truth", "both", rate("truth").alias("recall"), rate("found").alias("precision"))
