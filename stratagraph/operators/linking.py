"""Links between files: imports and framework links of extracted sources to their targets, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators.reachability import Closure, Index
from stratagraph.operators.resolve import first_match, suffixes
from stratagraph.sources.index import INJECTED, Relations
from stratagraph.staging import checkpointed

#: Times that a re-export may be followed, by pack.
HOPS = {"typescript": 5, "rust": 1, "python": 1, "java": 0, "cpp": 0}


def _tried(rel: Relations) -> DataFrame:
    """(from_file, ord, imported_name, pos, target_file): the candidate paths that exist; ``*/`` is a suffix, ``!/`` one that is unique."""
    files = rel.files.select(F.col("file").alias("target_file"))
    tried = rel.imports.select("from_file", "ord", "imported_name", F.posexplode("paths").alias("pos", "path"))
    plain = tried.where("path NOT LIKE '*/%' AND path NOT LIKE '!/%'") if rel.suffixed else tried
    met = plain.join(files, F.col("path") == F.col("target_file")).drop("path")
    if rel.suffixed:
        ends = files.select("target_file", F.explode(suffixes(F.col("target_file"))).alias("suffix")).groupBy("suffix").agg(F.min("target_file").alias("target_file"), F.count("*").alias("n"))
        by_end = tried.where("path LIKE '*/%' OR path LIKE '!/%'").withColumn("suffix", F.substring("path", 3, 1 << 20)).join(ends, "suffix").where("path LIKE '*/%' OR n = 1")
        met = met.unionByName(by_end.select(*met.columns))
    return met.where("from_file <> target_file")


def resolve_imports(rel: Relations, pack: str) -> DataFrame:
    """All imports with target_file and target (symbol or file id), null where nothing is found.

    The first candidate path that exists is the file. What the paths met is grouped once, files and declarations together;
    re-exports are followed where there are any.
    """
    declared = rel.symbols.where("is_top_level OR file LIKE '%.java'").select(F.col("file").alias("target_file"), F.regexp_extract("id", r"([^:.]*)$", 1).alias("name"), "id", F.col("ord").alias("s_ord"))
    declared = declared.groupBy("target_file", "name").agg(F.min_by("id", "s_ord").alias("id"))
    met = _tried(rel).withColumnRenamed("imported_name", "name").join(declared, ["target_file", "name"], "left")
    hit = F.when(F.col("id").isNotNull(), F.struct(F.col("pos").alias("rank"), "target_file", "id"))
    found = met.groupBy("from_file", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", "target_file"))).alias("found"), F.min(hit).alias("h"))
    out = rel.imports.drop("paths").join(found, ["from_file", "ord"], "left")
    best = F.col("h")
    if rel.chased and HOPS.get(pack, 0):
        out = out.join(_chased(rel, met, declared, found, HOPS[pack]), ["from_file", "ord"], "left")
        best = F.least("h", "later")
    first_file = F.get("found", F.lit(0)).target_file
    to_file = F.col("form").isin("module", "default", "include") | F.col("imported_name").isNull()
    # In Python a name may be a module of its own.
    module = F.get(F.filter("found", lambda f: F.regexp_extract(f.target_file, r"([^/]*?)(/__init__)?\.py$", 1) == F.col("imported_name")), F.lit(0)).target_file if pack == "python" else F.lit(None).cast("string")
    target_file = F.coalesce(best.target_file, module, first_file)
    target = F.coalesce(best.id, module, F.when(to_file, first_file))
    return out.select("from_file", "ord", "specifier", "imported_name", "local_name", "form", target_file.alias("target_file"), target.alias("target")).where(
        "form <> 'qualified' OR target IS NOT NULL"
    )


def _chased(rel: Relations, met: DataFrame, declared: DataFrame, found: DataFrame, hops: int) -> DataFrame:
    """(from_file, ord, later): the best of what re-exports lead to, at most ``hops`` of them."""
    reexports = rel.imports.where("form = 'reexport'").select(F.col("from_file").alias("target_file"), F.col("local_name").alias("name"), F.col("imported_name").alias("next_name"), F.col("ord").alias("r_ord"))
    hop_files = found.select(F.col("from_file").alias("target_file"), F.col("ord").alias("r_ord"), F.get("found", F.lit(0)).target_file.alias("next_file"))
    reexports = reexports.join(hop_files, ["target_file", "r_ord"]).groupBy("target_file", "name").agg(F.min_by("next_file", "r_ord").alias("next_file"), F.min_by("next_name", "r_ord").alias("next_name"))
    hits = None
    for hop in range(1, hops + 1):
        left = met.where("id IS NULL").drop("id").join(reexports, ["target_file", "name"]).select("from_file", "ord", F.col("next_name").alias("name"), "pos", F.col("next_file").alias("target_file"))
        met = left.join(declared, ["target_file", "name"], "left")
        hit = met.where("id IS NOT NULL").select("from_file", "ord", F.struct((F.col("pos") + 1000 * hop).alias("rank"), "target_file", "id").alias("hit"))
        hits = hit if hits is None else hits.unionByName(hit)
    return hits.groupBy("from_file", "ord").agg(F.min("hit").alias("later"))


def resolve_flows(rel: Relations, imports: DataFrame) -> DataFrame:
    """Framework links with target_file and target: routes by pattern, tables by name, components and names by import.

    Each kind is joined with what it may mean, by keys that are unique there, so that a link stays one row.
    """
    from stratagraph.operators.resolve import route_join

    symbols = rel.symbols.select("id", "file", "kind", "ord", "is_top_level", F.regexp_extract("id", r"([^:.]*)$", 1).alias("name"))
    kinds = lambda *k: rel.flows.where(F.col("kind").isin(*k))
    shown = lambda df, file, target: df.select("from_file", "ord", "kind", "raw", file.alias("target_file"), target.alias("target"))
    routes = rel.files.where("file LIKE 'app/api/%' AND file LIKE '%/route.ts'").select(
        F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("file", "^app/", ""), "/route\\.ts$", "")).alias("pattern"), F.lit(0).alias("ord")
    )
    literals = kinds("route-literal")
    by_route = literals.join(route_join(literals.select(F.col("raw").alias("path")), routes).withColumnRenamed("path", "raw"), "raw", "left")
    route = F.concat(F.lit("app"), "pattern", F.lit("/route.ts"))  # the pattern names its file
    tables = first_match(symbols.where("kind = 'schema'").withColumnRenamed("name", "raw"), ["raw"], ["file", "ord"], "id")
    by_table = kinds("table-ref").join(tables, "raw", "left")
    local = imports.where("target_file IS NOT NULL").groupBy("from_file", F.col("local_name").alias("raw")).agg(F.min_by(F.struct("target_file", F.coalesce("target", "target_file").alias("target")), "ord").alias("t"))
    by_import = kinds("component").join(local, ["from_file", "raw"], "left")
    direct = rel.flows.where("kind IS NULL OR kind NOT IN ('route-literal', 'table-ref', 'component', 'depends', 'parameter')")
    itself = F.col("kind") == "trait-impl"
    out = shown(by_route, route, route)
    out = out.unionByName(shown(by_table, F.substring_index("id", "::", 1), F.col("id")))
    out = out.unionByName(shown(by_import, F.col("t.target_file"), F.col("t.target")))
    out = out.unionByName(shown(direct, F.when(itself, F.col("from_file")), F.when(itself, F.col("raw"))))
    if not rel.injected:
        return out
    own = symbols.where("is_top_level").groupBy(F.col("file").alias("from_file"), F.col("name").alias("raw")).agg(F.min_by("id", "ord").alias("id"))
    named = kinds(*INJECTED).join(own, ["from_file", "raw"], "left").join(local, ["from_file", "raw"], "left")
    mine = F.col("id").isNotNull()
    return out.unionByName(shown(named, F.when(mine, F.col("from_file")).otherwise(F.col("t.target_file")), F.when(mine, F.col("id")).otherwise(F.col("t.target"))))


def include_hops(includes: DataFrame) -> DataFrame:
    """(a, b): a file and what it includes itself."""
    return includes.where("form = 'include' AND target_file IS NOT NULL").select(F.col("from_file").alias("a"), F.col("target_file").alias("b"))


def include_reach(includes: DataFrame) -> DataFrame:
    """(file, header): what a file includes, directly or not. All of it; for given pairs ask ``reachability.over``."""
    from stratagraph.operators.graph import reach

    hops = include_hops(includes)
    return reach(hops, hops.select(F.col("a").alias("start")).distinct()).select(F.col("start").alias("file"), F.col("node").alias("header"))


def same_package(rel: Relations) -> DataFrame:
    """(from_file, target): types of a file's own folder whose name its text writes and no explicit import shadows."""
    folder = F.regexp_extract("file", "^(.*?)/?[^/]*$", 1)
    types = rel.symbols.where("is_top_level AND kind IN ('container', 'schema')").select(folder.alias("dir"), F.col("file").alias("target_file"), F.regexp_extract("id", r"([^:.]*)$", 1).alias("word"), F.col("id").alias("target"))
    wrote = rel.words.select("file", folder.alias("dir"), "word").join(types, ["dir", "word"]).where("file <> target_file")
    explicit = rel.imports.where("form = 'named'").select(F.col("from_file").alias("file"), F.col("local_name").alias("word"))
    return wrote.join(explicit, ["file", "word"], "left_anti").select(F.col("file").alias("from_file"), "target").distinct()


def cpp_edges(rel: Relations, far: Closure | Index) -> DataFrame:
    """(from_file, target): top-level symbols of the headers that a file reaches whose names it writes.

    Words meet names first; what they leave is asked of ``far``, pair by pair.
    """
    top = rel.symbols.where("is_top_level").select(F.col("file").alias("header"), F.regexp_extract("id", r"([^:.]*)$", 1).alias("word"), "id")
    outer = rel.symbols.where("is_top_level AND raw = 'enum'").select(F.col("id").alias("parent"))  # a nested enum's constants need their class
    inner = rel.symbols.where("raw = 'enumerator'").join(outer, "parent", "left_semi").select(F.col("file").alias("header"), F.regexp_extract("id", r"([^:.]*)$", 1).alias("word"), F.col("parent").alias("id"))
    wrote = rel.words.select("file", "word").join(top.unionByName(inner), "word").where("file <> header").select("file", "header", "id").distinct()
    wrote = checkpointed(wrote)
    return wrote.join(far.among(wrote, "file", "header"), ["file", "header"], "left_semi").select(F.col("file").alias("from_file"), F.col("id").alias("target")).distinct()
