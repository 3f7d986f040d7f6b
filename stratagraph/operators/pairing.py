"""Definitions outside their declarations: which declaration each belongs to, and what that adds to its hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.intervals import above, numbered
from stratagraph.operators.reachability import Closure, Index
from stratagraph.staging import checkpointed


def pairable() -> Column:
    """A top-level exported definition written with its scope, or a plain function with a body."""
    return F.col("is_top_level") & F.col("is_exported") & (F.col("raw").startswith("qualified_") | (F.col("raw") == "function"))


def _names(suffix: Column, chain: Column) -> Column:
    """(depth, name) of every scope that a definition may mean: its own namespaces first, then outer ones."""
    parts = F.split(suffix, "::")
    outer = F.least(chain, F.size(parts) - 1)
    return F.transform(F.sequence(F.lit(0), outer), lambda d: F.struct(d.alias("depth"), F.array_join(F.concat(F.slice(parts, 1, outer - d), F.slice(parts, outer + 1, F.size(parts))), "::").alias("name")))


def pair(symbols: DataFrame, far: Closure | Index) -> DataFrame:
    """(id, target, how) of every pairable definition: paired, class, ambiguous or unmatched.

    symbols(id, file, kind, raw, markers, is_top_level, is_exported); far says which headers a file includes,
    directly or not: only pairs of files that share a name are asked for. Declarations join on the name after the file; only the innermost scope that has
    one counts, and only if it has no other. A definition without a declaration goes to its class.
    """
    after = F.expr("substring(id, length(file) + 3)")
    chain = F.coalesce(F.get(F.filter(F.transform("markers", lambda m: F.regexp_extract(m, "^chain:([0-9]+)$", 1).try_cast("int")), lambda n: n.isNotNull()), F.lit(0)), F.lit(0))
    made = symbols.where(pairable()).select("id", "file", F.explode(_names(after, chain)).alias("n")).select("id", "file", "n.depth", "n.name")
    declares = (F.col("kind") == "callable") & ~F.col("raw").startswith("qualified_") | (F.col("kind") == "value") & (F.col("raw") == "field")
    classes = (F.col("kind") == "container") & F.col("raw").isin("class", "struct", "union")

    def nearest(names: DataFrame, test: Column) -> DataFrame:
        known = symbols.where(test).select(F.col("id").alias("target"), F.col("file").alias("header"), after.alias("name"))
        met = checkpointed(names.join(known, "name").where("id <> target AND file <> header"))
        met = met.join(far.among(met, "file", "header"), ["file", "header"], "left_semi")
        per = met.groupBy("id", "depth").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
        return per.groupBy("id").agg(F.min_by(F.struct("n", "target"), "depth").alias("b")).select("id", "b.n", "b.target")

    members = nearest(made, declares)
    owners = nearest(made.where("name LIKE '%::%'").withColumn("name", F.regexp_replace("name", "::[^:]*$", "")), classes)
    every = made.select("id").distinct().join(members.toDF("id", "mn", "member"), "id", "left").join(owners.toDF("id", "on", "owner"), "id", "left")
    how = F.when(F.col("mn") == 1, "paired").when(F.col("mn") > 1, "ambiguous").when(F.col("on") == 1, "class").when(F.col("on") > 1, "ambiguous").otherwise("unmatched")
    target = F.when(F.col("mn") == 1, F.col("member")).when(F.col("mn").isNull() & (F.col("on") == 1), F.col("owner"))
    return every.select("id", target.alias("target"), how.alias("how"))


#: Hexadecimal digits by which a node's parts are put in order, chunk by chunk.
CHUNK_DIGITS = 3


def absorbed(nodes: DataFrame, parts: DataFrame, id_: str = "id") -> DataFrame:
    """nodes(id, parent, hash) with what parts(target, hash) add: to the target, and to all that encloses it.

    A node takes the hashes of all parts below it, in order and with repeats. Equal parts meet as a count, and a node's
    parts are put in order by chunks of the first digits; one task then has a node's text, 65 bytes a part, to hash it.
    """
    points = parts.where("target IS NOT NULL").select(F.col("target").alias("id"), F.col("hash").alias("part"))
    enclosing = above(numbered(nodes.select(F.col(id_).alias("id"), "parent")), points.select("id").distinct())
    met = points.join(enclosing, "id").groupBy(F.col("ancestor").alias(id_), "part").agg(F.count("*").cast("int").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "n")))
    text = F.array_join(F.flatten(F.transform(ordered, lambda p: F.array_repeat(p.part, p.n))), "\n")
    chunks = met.groupBy(id_, F.substring("part", 1, CHUNK_DIGITS).alias("chunk")).agg(text.alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda c: c.text), "\n")
    out = nodes.join(chunks.groupBy(id_).agg(whole.alias("parts")), id_, "left")
    return out.withColumn("hash", F.when(F.col("parts").isNull(), F.col("hash")).otherwise(F.sha2(F.concat_ws("\n", "hash", "parts"), 256))).drop("parts")


def descendant_spans(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, file, start_line, end_line): the spans(target, file, start_line, end_line) of a symbol and of all below it."""
    points = spans.select(F.col("target").alias("id"), "file", "start_line", "end_line")
    return above(numbered(nodes.select("id", "parent")), points).select(F.col("ancestor").alias("id"), "file", "start_line", "end_line")


def moved(symbols: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols without the paired definitions, and those definitions with their target."""
    gone = checkpointed(symbols.join(pairs.where("target IS NOT NULL").select("id", "target"), "id"))
    return symbols.join(gone.select("id"), "id", "left_anti"), gone


def apply(symbols: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols without the paired definitions, their targets' hashes moved; and (target, file, start_line, end_line) of what moved."""
    left, gone = moved(symbols, pairs)
    hashed = absorbed(left.select("id", "parent", F.col("source_hash").alias("hash")), gone.select("target", F.col("source_hash").alias("hash")))
    fresh = hashed.select("id", F.col("hash").alias("_hash"))
    return left.join(fresh, "id").withColumn("source_hash", F.col("_hash")).select(*symbols.columns), gone.select("target", "file", "start_line", "end_line")
