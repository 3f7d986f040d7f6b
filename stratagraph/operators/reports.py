"""Rules over grouped rows that reports, statuses and lookups share. Columns and tests are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.operators.ordered import dealt, numbered


#: Pages up to which a file is shown whole.
RAW_PAGES = 12


def status_of(missing: Column, current: Column) -> Column:
    """Aggregate: missing if all parts are, current if all are, else stale."""
    return F.when(F.bool_and(missing), "missing").when(F.bool_and(current), "current").otherwise("stale")


def file_status(parts: DataFrame, key: str, missing: Column, current: Column) -> DataFrame:
    """(key, status): missing if all parts are, current if all are, else stale."""
    return parts.groupBy(key).agg(status_of(missing, current).alias("status"))


def pending_generations(parts: DataFrame, key: str, pending: Column, own: Column) -> DataFrame:
    """(key, generations): pending parts, and one more where the file's own document is due."""
    return parts.groupBy(key).agg((F.count_if(pending) + F.max(own.cast("int"))).alias("generations"))


def generated_count(files: DataFrame, generated: Column) -> DataFrame:
    return files.agg(F.count_if(generated).alias("generated"), F.count("*").alias("files"))


def worst_read(files: DataFrame, key: str, errors: str, rank: Column, n: int = 10) -> DataFrame:
    """The n files with most errors, in order of rank, beside the totals of all."""
    totals = files.agg(F.count_if(F.col(errors) > 0).alias("files"), F.sum(errors).alias("all_errors"))  # one row
    worst = files.where(F.col(errors) > 0).select(key, F.col(errors).alias("errors"), rank.alias("rank")).orderBy("rank", F.desc("errors"), key).limit(n)
    return worst.crossJoin(F.broadcast(totals))


def children_gate(children: DataFrame, parent: str, done: Column) -> DataFrame:
    """(parent, ready, blocking): an upper document's task opens only when all its children are current."""
    return children.groupBy(parent).agg(F.bool_and(done).alias("ready"), F.count_if(~done).alias("blocking"))


def bottom_up(units: DataFrame) -> DataFrame:
    """Units (id, kind, module) in the order of work: files by folder, then folders, features and the system."""
    rank = F.when(F.col("kind") == "file", 0).when(F.col("kind") == "rollup", 1).when(F.col("kind") == "feature", 2).otherwise(3)
    return units.withColumn("rank", rank).orderBy("rank", "module", "id")


def ladder(pages: Column, share: Column, parts: Column, most: int = RAW_PAGES, dominant: int = 70, many: int = 8) -> Column:
    """How a file of so many pages is shown: whole if few, an outline if one part dominates, summaries if it has many parts."""
    return F.when(pages <= most, "raw").when(share >= dominant, "outline").when(parts >= many, "summaries").otherwise("raw")


def share_of(part: Column, whole: Column) -> Column:
    """Whole percent, at most 100; 0 of nothing."""
    return F.least(F.lit(100), F.when(whole == 0, 0).otherwise(F.floor(part * 100 / whole))).cast("int")


def largest_part(parts: DataFrame, key: str, part: str, size: Column) -> DataFrame:
    """(key, part, percent): each key's largest part, the first of equals, and its share of the whole."""
    s = parts.groupBy(key).agg(F.max_by(part, F.struct(size.alias("b"), (-F.col(part)).alias("o"))).alias(part), F.max(size).alias("big"), F.sum(size).alias("every"))
    return s.select(key, part, share_of(F.col("big"), F.col("every")).alias("percent"))


def members_in_order(parts: DataFrame, live: DataFrame, key: str, on: str, order: list[str]) -> DataFrame:
    """(key, rows): each key's live parts as structs in declaration order."""
    return parts.join(live.select(on), on, "left_semi").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("rows"))


def nearest_ranks(values: DataFrame, key: str, value: str, ranks: dict[str, float]) -> DataFrame:
    """Percentiles by nearest rank, exact. Null values do not count; a key with no other has no row.

    Counted values are dealt by range, which splits a key. A row a range and key says which range holds which rank,
    and only those ranges are put in order.
    """
    counts = dealt(values.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n")), key, [value])
    own = counts.groupBy(key, "_range").agg(F.sum("_n").alias("_own"))
    of = Window.partitionBy(key)
    sums = own.withColumn("_upto", F.sum("_own").over(of.orderBy("_range"))).withColumn("_all", F.sum("_own").over(of))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.round((F.col("_all") - 1) * F.lit(p)) + 1).alias("rank")) for name, p in ranks.items()]))
    held = sums.select(F.col(key).alias("_of"), F.col("_range").alias("_at"), (F.col("_upto") - F.col("_own")).alias("_past"), "_upto", asked.alias("_asked"))
    held = held.where("_asked.rank > _past AND _asked.rank <= _upto")
    met = counts.join(held, (F.col("_range") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_of")))
    here = F.col("_past") + F.sum("_n").over(Window.partitionBy(key, "_at", "_asked").orderBy(value))
    at = lambda name: F.min(F.when(F.col("_asked.name") == name, F.col(value)))
    return met.withColumn("_here", here).where("_here >= _asked.rank").groupBy(key).agg(*[at(name).alias(name) for name in ranks])


def identical_sets(rows: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """(group, identical): at least two members, and all have the same values."""
    own = F.array_join(F.transform(F.sort_array(F.collect_list(value)), lambda x: x.cast("string")), ",")
    return rows.groupBy(group, member).agg(own.alias("own")).groupBy(group).agg(((F.count("*") >= 2) & (F.count_distinct("own") == 1)).alias("identical"))


def outcomes(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row: how many rows pass each test."""
    return rows.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


def counts_of(rows: DataFrame, what: Column, name: str) -> DataFrame:
    """(name, documents): how many rows have each outcome."""
    return rows.groupBy(what.alias(name)).agg(F.count("*").alias("documents"))


def edge_order(edges: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Edges with ``ord``, numbered from 1 within their source by a total order, so that builds agree."""
    return numbered(edges, source, order, "ord")


def in_sync(now: DataFrame, recorded: DataFrame, key: str, value: str = "hash") -> DataFrame:
    """(key, in_sync) of what both have."""
    return now.join(recorded.select(key, F.col(value).alias("_recorded")), key).select(key, (F.col(value) == F.col("_recorded")).alias("in_sync"))


def top_counts(rows: DataFrame, key: str, name: str, n: int = 10) -> DataFrame:
    """The n keys with most rows; equal counts by key."""
    return rows.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key).limit(n)


def distinct_dependants(edges: DataFrame, targets: DataFrame, source: str, target: str) -> DataFrame:
    """One row: distinct edges that lead to the given targets."""
    return edges.join(targets.select(target), target, "left_semi").select(source, target).distinct().agg(F.count("*").alias("dependants"))


def tier_hashes(tiers: dict[str, tuple[DataFrame, str, Column]], hashed) -> DataFrame:
    """(tier, target, hash) of the participants of each tier: (rows, key, what is hashed)."""
    parts = [rows.select(F.lit(tier).alias("tier"), F.col(key).alias("target"), hashed(text).alias("hash")) for tier, (rows, key, text) in tiers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def child_hashes(children: DataFrame, now: DataFrame, stored: DataFrame, key: str, value: str = "hash") -> DataFrame:
    """Children with ``child_hash``: the recorded hash, blank if there is none or it has moved."""
    both = children.join(now.select(key, F.col(value).alias("_now")), key).join(stored.select(key, F.col(value).alias("_stored")), key, "left")
    return both.withColumn("child_hash", F.when(F.col("_stored").isNull() | (F.col("_stored") != F.col("_now")), "").otherwise(F.col("_stored"))).drop("_now", "_stored")


def nested_causes(rows: DataFrame, cause: str, inner: str, top: str = "system") -> DataFrame:
    """(document, cause, files, because): the top document's causes, each with its own causes counted."""
    f = rows.groupBy(cause, inner).agg(F.count("*").alias("files"))
    because = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(inner, "files"))), lambda x: F.concat_ws("=", x[inner], x.files)), ",")
    return f.groupBy(cause).agg(because.alias("because"), F.sum("files").alias("files")).select(F.lit(top).alias("document"), F.col(cause).alias("cause"), "files", "because")


def outline(rows: DataFrame, key: str, order: str, head: Column, text: str, most: int) -> DataFrame:
    """(key, shown): a container's members in order, whole up to ``most`` bytes, else their heads."""
    own = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, head.alias("head"), text))).alias("r"), F.sum(F.octet_length(text)).alias("size"))
    return own.select(key, F.array_join(F.when(F.col("size") > most, F.transform("r", lambda x: x["head"])).otherwise(F.transform("r", lambda x: x[text])), "\n").alias("shown"))


def fold_cost(edges: DataFrame, target: str, source: str, names: Column) -> DataFrame:
    """(target, importers, naming): distinct files that import a target, and edges that name it."""
    return edges.groupBy(target).agg(F.count_distinct(source).alias("importers"), F.count_if(names).alias("naming"))


def change_parts(change: Column) -> tuple[Column, Column]:
    """A change ``action:target`` as its two halves; the target may hold colons."""
    parts = F.split(change, ":", 2)
    return parts[0], parts[1]


def anchors(rows: DataFrame, key: str, order: str, heading: Column) -> DataFrame:
    """Rows with ``anchor``: the heading in lower case with hyphens; repeats of a document get -1, -2 and so on."""
    a = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9 ]", ""), " +", "-"), "^-+|-+$", "")
    out = numbered(rows.withColumn("_a", a).withColumn("_k", F.struct(key, "_a")), "_k", [order], "_n")
    return out.withColumn("anchor", F.when(F.col("_n") > 1, F.concat_ws("-", "_a", (F.col("_n") - 1).cast("string"))).otherwise(F.col("_a"))).drop("_a", "_k", "_n")


def dependency_context(rows: DataFrame, targets: DataFrame, on: Column, summary: str, fallback: Column) -> DataFrame:
    """Rows with ``context``: what the target's document says of it, else its own head."""
    return rows.join(targets, on, "left").withColumn("context", F.coalesce(summary, fallback))


def externals(rows: DataFrame, key: str, specifier: Column) -> DataFrame:
    """(key, package, uses): unresolved specifiers by their package, the part before the first slash or colon."""
    return rows.groupBy(key, F.regexp_extract(specifier, "^[^/:]*[/:]*([^/:]*)", 1).alias("package")).agg(F.count("*").alias("uses"))


def file_dependencies(edges: DataFrame, targets: DataFrame, source: str, target: str, value: str) -> DataFrame:
    """Distinct (source, target, value): a file's resolved targets with what is hashed of them."""
    return edges.select(source, target).join(targets.select(target, value), target).select(source, target, value).distinct()


def default_targets(imports: DataFrame, declared: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """(source, target): imports of a file as a whole, each to the declaration that its file exports by default."""
    return imports.select(source, key).join(declared.select(key, target), key).select(source, target)


def same_file_pairs(left: DataFrame, right: DataFrame, keys: list[str], file: str) -> DataFrame:
    """Distinct pairs of an implementation and a type that one file declares under one name."""
    return left.join(right, keys).select(file, *[c for c in [*left.columns, *right.columns] if c not in keys]).distinct()


def named_tables(names: DataFrame, tables: DataFrame, name: str, table: str, target: str) -> DataFrame:
    """(name, target): the first schema symbol that a reference names as it stands or in capitals."""
    tried = names.select(name, F.explode(F.array(F.col(name), F.upper(F.substring(name, 3, 100)))).alias(table)).distinct()
    first = tables.groupBy(table).agg(F.min(target).alias("_target"))
    return tried.join(first, table).groupBy(name).agg(F.min("_target").alias("target"))


def link_literals(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, literal) of every literal that a pattern's first group finds."""
    return texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("literal"))


def distinct_tags(text: Column) -> Column:
    """The sorted distinct tags of a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("<([a-z][a-z0-9]*)"), F.lit(1))))


def owned(nodes: DataFrame, owners: DataFrame, ids: list, key: str, owner: str, on: str) -> DataFrame:
    """The named nodes, each with its owner."""
    return nodes.where(F.col(key).isin(ids)).join(owners, F.col(owner) == F.col(on))


def event_sets(events: DataFrame, key: list, value: str) -> DataFrame:
    """(key, kinds): the distinct values of each key's events, sorted: what a batch of file events touched."""
    return events.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias("kinds"))
