"""Operators over node and edge tables: callers, fan-in, degrees, traversal, components."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.staging import checkpointed, dropped, observed, staying


def callers(nodes: DataFrame, edges: DataFrame, node: str = "id", target: str = "target") -> DataFrame:
    """Edges that lead to the given nodes."""
    return edges.join(nodes.select(F.col(node).alias(target)).distinct(), target, "left_semi")


def callees(edges: DataFrame, nodes: DataFrame, node: str = "id", target: str = "target", resolved: str = "resolved") -> DataFrame:
    """All edges; ``resolved`` is the target if it is a known node, else null."""
    known = nodes.select(F.col(node).alias(resolved)).distinct()
    return edges.join(known, edges[target] == known[resolved], "left")


def new_edges(edges: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct edges that aren't known yet."""
    return edges.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")


def fan_in(edges: DataFrame, parent: str, counted: Column | None = None) -> DataFrame:
    """Edges per parent: edges, not distinct sources; one pass for all parents."""
    return (edges if counted is None else edges.where(counted)).groupBy(parent).agg(F.count("*").alias("fan_in"))


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b") -> DataFrame:
    """(node, fan_out, fan_in) over distinct edges without self edges; nodes without edges have zeros."""
    own = edges.where(F.col(a) != F.col(b)).select(a, b).distinct()
    ends = own.select(F.col(a).alias(node), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(own.select(F.col(b).alias(node), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy(node).agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))
    return nodes.select(node).join(sums, node, "left").select(node, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_out", "fan_in")])


def concentration(counts: DataFrame, value: str, tie: str) -> DataFrame:
    """Share of ``value`` that the top tenth of the rows (at least one) holds.

    Only a value's rows are counted per value, so no window sees more than the distinct values.
    """
    sums = counts.agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    by_value = counts.groupBy(value).agg(F.count("*").alias("rows"))
    above = Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)  # a row per distinct degree
    ranked = by_value.withColumn("before", F.coalesce(F.sum("rows").over(above), F.lit(0)))
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 10))
    take = F.greatest(F.lit(0), F.least(F.col("rows"), k - F.col("before")))
    return ranked.crossJoin(F.broadcast(sums)).agg(F.first("n").alias("n_nodes"), F.sum(take * F.col(value)).alias("top_edges"), F.first("total").alias("all_edges"))  # sums: one row


def top_degrees(counts: DataFrame, value: str, name: str, n: int = 5) -> DataFrame:
    return counts.orderBy(F.desc(value), F.asc(name)).limit(n)


#: Starts in a cell: bits of a long.
CELL = 64
#: Starts that are numbered together, about.
DEAL = 4096


def coded(starts: DataFrame, start: str = "start") -> DataFrame:
    """(start, cell, bit), staged: the distinct starts, 64 to a cell."""
    own = checkpointed(starts.select(F.col(start).alias("start")).where("start IS NOT NULL").distinct())
    parts = max(1, own.count() // DEAL)
    dealt = own.withColumn("part", F.pmod(F.xxhash64("start"), F.lit(parts)))
    at = F.row_number().over(Window.partitionBy("part").orderBy("start")) - 1  # about DEAL rows a part
    return checkpointed(dealt.withColumn("at", at).select("start", (F.col("part") * (1 << 24) + F.floor(F.col("at") / CELL)).alias("cell"), (F.col("at") % CELL).cast("int").alias("bit")))


def _bit() -> Column:
    return F.expr("shiftleft(1L, bit)")


def packed_levels(hops: DataFrame, seeds: DataFrame, masks: DataFrame | None = None, depth: int | None = None) -> Iterator[tuple[int, DataFrame, int]]:
    """Breadth first from all starts at once: (level, (node, cell, bits, fresh), pairs that are new) of each level.

    hops(node, next); seeds(node, cell, bits); masks(node, cell, mask): the starts that may enter a node, those of
    every cell where the cell is null; without masks all may. A row holds 64 starts, frontiers meet by ``bit_or``,
    and a level is one join, one aggregate and one write. The caller keeps what it needs: the next level is made
    from the last one alone, whose ``bits`` are all that was ever seen.
    """
    size = hops.count()
    now, level = checkpointed(seeds.groupBy("node", "cell").agg(F.bit_or("bits").alias("bits")).withColumn("fresh", F.col("bits"))), 0
    yield 0, now, 0
    while depth is None or level < depth:
        level += 1
        sent = now.where("fresh <> 0").join(staying(hops, size), "node").groupBy(F.col("next").alias("node"), "cell").agg(F.bit_or("fresh").alias("sent"))
        if masks is not None:
            own = masks.where("cell IS NOT NULL").groupBy("node", "cell").agg(F.bit_or("mask").alias("own"))
            free = masks.where("cell IS NULL").groupBy("node").agg(F.bit_or("mask").alias("free"))
            sent = sent.join(staying(own, size), ["node", "cell"], "left").join(staying(free, size), "node", "left").select("node", "cell", F.expr("sent & (coalesce(own, 0L) | coalesce(free, 0L))").alias("sent"))
        both = now.select("node", "cell", "bits", F.lit(0).cast("long").alias("sent")).unionByName(sent.select("node", "cell", F.lit(0).cast("long").alias("bits"), "sent"))
        met = both.groupBy("node", "cell").agg(F.bit_or("bits").alias("old"), F.bit_or("sent").alias("sent"))
        step = met.select("node", "cell", F.expr("old | sent").alias("bits"), F.expr("sent & ~old").alias("fresh"))
        now, seen = observed(step, n=F.sum(F.bit_count("fresh")))
        if not seen["n"]:
            return
        yield level, now, seen["n"]


def unpacked(rows: DataFrame, codes: DataFrame, bits: str = "bits") -> DataFrame:
    """rows(cell, bits, ...) to a row (start, ...) for each start in them."""
    each = rows.withColumn("bit", F.explode(F.expr(f"filter(sequence(0, {CELL - 1}), k -> (shiftrightunsigned({bits}, k) & 1) = 1)"))).drop(bits)
    return each.join(codes, ["cell", "bit"]).drop("cell", "bit")


def _seeds(codes: DataFrame, at: DataFrame) -> DataFrame:
    """at(start, node) as packed rows."""
    return at.join(codes, "start").select("node", "cell", _bit().alias("bits"))


def _hops(edges: DataFrame, a: str, b: str) -> DataFrame:
    return checkpointed(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where("node <> next").distinct())


def reach(edges: DataFrame, starts: DataFrame, a: str = "a", b: str = "b", depth: int | None = None) -> DataFrame:
    """(start, node) for every node reached from a start, itself excluded; cycles end. The result is the closure.

    Where only given pairs are asked for, ``reachability.Index`` does without it.
    """
    hops, codes = _hops(edges, a, b), coded(starts)
    last = None
    for _, now, _ in packed_levels(hops, _seeds(codes, codes.select("start", F.col("start").alias("node"))), depth=depth):
        if last is not None:
            dropped(last)
        last = now
    return unpacked(last.select("node", "cell", "bits"), codes).where("start <> node").select("start", "node")


def participants(entries: DataFrame, edges: DataFrame, admitted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(entry, tier, target) of every entry at once, 64 entries a row.

    entries(entry, file); edges(from_file, target_file, target); admitted(entry, file): files that
    may join an entry's core, or every entry's where the entry is null; symbols(id, file, kind). Files with a schema symbol never join the
    core. From the core, one hop to symbols: schema symbols are data, others dependencies; symbols
    of core files are neither.
    """
    codes = coded(entries, "entry")
    schema_files = symbols.where("kind = 'schema'").select("file").distinct()
    may = admitted.join(schema_files, "file", "left_anti").select("entry", F.col("file").alias("node"))
    own = may.withColumnRenamed("entry", "start").join(codes, "start").select("node", "cell", _bit().alias("mask"))
    masks = checkpointed(own.unionByName(may.where("entry IS NULL").select("node").distinct().select("node", F.lit(None).cast("long").alias("cell"), F.lit(-1).cast("long").alias("mask"))))
    hops = _hops(edges.where("target_file IS NOT NULL"), "from_file", "target_file")
    last = None
    for _, now, _ in packed_levels(hops, _seeds(codes, entries.select(F.col("entry").alias("start"), F.col("file").alias("node"))), masks):
        if last is not None:
            dropped(last)
        last = now
    core = last.select(F.col("node").alias("file"), "cell", "bits")
    targets = edges.where("target IS NOT NULL").select(F.col("from_file").alias("file"), F.col("target").alias("id")).distinct()
    reached = core.join(targets, "file").groupBy("id", "cell").agg(F.bit_or("bits").alias("bits"))
    known = reached.join(symbols.select("id", "file", "kind"), "id").join(core.select("file", "cell", F.col("bits").alias("inside")), ["file", "cell"], "left")
    known = known.select("id", "kind", "cell", F.expr("bits & ~coalesce(inside, 0L)").alias("bits")).where("bits <> 0")
    tier = F.when(F.col("kind") == "schema", "data").otherwise("dependencies")
    files = unpacked(core, codes).select(F.col("start").alias("entry"), F.lit("core").alias("tier"), F.col("file").alias("target"))
    return files.unionByName(unpacked(known, codes).select(F.col("start").alias("entry"), tier.alias("tier"), F.col("id").alias("target")).distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each weakly connected component.

    Hash-to-min with pointer jumping: each round joins every node to its neighbours' smallest
    label and then to that label's own label, so rounds grow with the logarithm of the diameter.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(edges.select(F.col(b).alias("node"), F.col(a).alias("other"))).distinct()
    both = checkpointed(both)
    labels, nodes = observed(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), n=F.count("*"))
    size = nodes["n"]
    while True:
        seen = both.join(staying(labels.select(F.col("node").alias("other"), "component"), size), "other").groupBy("node").agg(F.min("component").alias("low"))
        step = labels.join(staying(seen, size), "node").select("node", F.least("component", "low").alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new, moved = observed(step.join(staying(jump, size), "component").select("node", F.least("component", "further").alias("component"), "old"), n=F.count_if(F.col("component") != F.col("old")))
        dropped(labels)
        labels = new
        if not moved["n"]:
            return new.select("node", "component")


def _colours(edges: DataFrame, seed: int, size: int) -> DataFrame:
    """(node, f, b): of all that reach a node, and of all that it reaches, the one that comes first in a random order.

    Colours move one edge a round, and along a pointer to a node further up or down, which doubles its length each
    round; so a long chain or cycle takes rounds by its logarithm. ``size``: of the edges; nodes are at most twice as many.
    """
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(seed)).alias("r"), F.col(c).alias("id"))
    ends = edges.select(F.col("b").alias("node"), F.col("a").alias("up"), F.lit(None).cast(edges.schema["a"].dataType).alias("down"))
    ends = ends.unionByName(edges.select(F.col("a").alias("node"), F.lit(None).cast(edges.schema["a"].dataType).alias("up"), F.col("b").alias("down")))
    now = ends.groupBy("node").agg(F.min("up").alias("up"), F.min("down").alias("down"))
    now = checkpointed(now.select("node", rank("node").alias("f"), rank("node").alias("b"), F.coalesce("up", "node").alias("up"), F.coalesce("down", "node").alias("down")))
    while True:
        fore = edges.join(staying(now.select(F.col("node").alias("a"), "f"), size), "a").select(F.col("b").alias("node"), "f", F.lit(None).cast(now.schema["b"].dataType).alias("b"))
        back = edges.join(staying(now.select(F.col("node").alias("b"), F.col("b").alias("c")), size), "b").select(F.col("a").alias("node"), F.lit(None).cast(now.schema["f"].dataType).alias("f"), F.col("c").alias("b"))
        told = fore.unionByName(back).groupBy("node").agg(F.min("f").alias("nf"), F.min("b").alias("nb"))
        above_ = now.select(F.col("node").alias("up"), F.col("f").alias("uf"), F.col("up").alias("uup"))
        below_ = now.select(F.col("node").alias("down"), F.col("b").alias("db"), F.col("down").alias("ddown"))
        step = now.join(staying(told, size), "node", "left").join(staying(above_, size), "up").join(staying(below_, size), "down")
        step = step.select("node", F.least("f", "nf", "uf").alias("f2"), F.least("b", "nb", "db").alias("b2"), F.col("uup").alias("up"), F.col("ddown").alias("down"), "f", "b")
        new, moved = observed(step.select("node", F.col("f2").alias("f"), F.col("b2").alias("b"), "up", "down", ((F.col("f2") != F.col("f")) | (F.col("b2") != F.col("b"))).alias("moved")), n=F.count_if("moved"))
        dropped(now)
        now = new.drop("moved")
        if not moved["n"]:
            return now.select("node", F.col("f.id").alias("f"), F.col("b.id").alias("b"))


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """Edges that have one before and one behind, and their number; again as long as an eighth of them goes."""
    left, n, before = edges, edges.count(), None
    while n and (before is None or 8 * n <= 7 * before):
        step = left.join(staying(left.select(F.col("b").alias("a")).distinct(), n), "a", "left_semi")
        step = step.join(staying(left.select(F.col("a").alias("b")).distinct(), n), "b", "left_semi").select("a", "b")
        left, kept = observed(step, n=F.count("*"))
        before, n = n, kept["n"]
    return left, n


def strong_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): nodes that reach each other, by the smallest of them; single nodes are left out.

    Nodes without an edge in or out go. Every other takes two colours: the first in a random order of all that reach
    it, and of all that it reaches. Where both are one node, the node belongs to its component; edges between nodes of
    different colours lie in none. What is left is smaller pieces, coloured in another order, until no edge is left.
    No table is larger than the edges.
    """
    left, found, seed = checkpointed(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()), None, 0
    while True:
        left, n = _trimmed(left)
        if not n:
            break
        seed += 1
        colours = checkpointed(_colours(left, seed, n))
        own = colours.where("f = b").select("node", F.col("f").alias("root"))
        found = own if found is None else found.unionByName(own)
        at = lambda c: colours.select(F.col("node").alias(c), F.col("f").alias(f"f{c}"), F.col("b").alias(f"b{c}"))
        left = checkpointed(left.join(staying(at("a"), n), "a").join(staying(at("b"), n), "b").where("fa = fb AND ba = bb AND fa <> ba").select("a", "b"))
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    sized = checkpointed(found.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1"))
    return found.join(sized, "root").select("node", "component")


def distances(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Mean distance and diameter of the largest component, undirected: (nodes, mean_distance, diameter), one row.

    Of components of equal size that of the smallest node counts. Only the number of pairs of each distance is kept.
    """
    both = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = checkpointed(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    member = checkpointed(components(both))
    sizes = member.groupBy("component").agg(F.count("*").alias("n"))
    own = checkpointed(member.join(sizes.orderBy(F.desc("n"), "component").limit(1), "component", "left_semi").select(F.col("node").alias("start")))
    hops = _hops(both.join(own.select(F.col("start").alias("a")), "a", "left_semi"), "a", "b")
    codes = coded(own)
    last, far, pairs, total = None, 0, 0, 0
    for level, now, n in packed_levels(hops, _seeds(codes, codes.select("start", F.col("start").alias("node")))):
        if last is not None:
            dropped(last)
        last, far, pairs, total = now, level, pairs + n, total + level * n
    spark = edges.sparkSession
    return spark.createDataFrame([(codes.count(), total / pairs if pairs else None, far if pairs else None)], "nodes long, mean_distance double, diameter int")
