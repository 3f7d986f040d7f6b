"""Coverage family: ``documents LEFT JOIN labels`` as documents that should exist and their status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import coverage as C
from stratagraph.operators import reports as R
from stratagraph.plans.registry import Tables, query

ITEMS_SQL = """items AS (
  SELECT d.doc_id AS id, 'file' AS kind, d.source AS module, d.lang,
         CASE WHEN d.doc_id % 11 = 0 THEN 'test' ELSE 'domain' END AS role,
         CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.quality = 1 THEN 'current' ELSE 'stale' END AS status,
         coalesce(l.toxic = 1, false) AS smelly, (d.n_chars // 100)::BIGINT AS fan_in
  FROM documents d LEFT JOIN labels l USING (doc_id)
)"""
SUMS_SQL = """count(*) FILTER (status = 'current') AS current, count(*) FILTER (status = 'stale') AS stale,
  count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (smelly) AS smelly, count(*) AS total"""
RATIOS_SQL = """CASE WHEN current + stale = 0 THEN 1.0 ELSE current / (current + stale) END AS freshness,
  CASE WHEN total = 0 THEN 1.0 ELSE (current + stale) / total END AS coverage"""
# Four kinds of document over the same rows: files, a rollup per source, a feature per source and language, one system.
ALL_SQL = ITEMS_SQL + """, kids AS (
  SELECT 'rollup' AS kind, module AS id, module, status FROM items
  UNION ALL SELECT 'feature', module || '/' || lang, module, status FROM items
  UNION ALL SELECT 'system', 'system', '.', status FROM items
), folded AS (
  SELECT kind, id, module, CASE WHEN bool_and(status = 'missing') THEN 'missing' WHEN bool_or(status <> 'current') THEN 'stale' ELSE 'current' END AS status
  FROM kids GROUP BY kind, id, module
), every AS (
  SELECT kind, id::VARCHAR AS id, module, role, status, smelly, fan_in FROM items
  UNION ALL SELECT kind, id, module, 'domain', status, false, 0 FROM folded
)"""


def items(t: Tables) -> DataFrame:
    """Files with status, smell and a fan-in; a document without a label is missing, label 0 is stale."""
    labels = t.labels.select(F.col("doc_id").alias("l_id"), "quality", "toxic")
    d = t.documents.select("doc_id", "source", "lang", "n_chars")
    status = F.when(F.col("l_id").isNull(), "missing").when(F.col("quality") == 1, "current").otherwise("stale")
    return d.join(labels, d.doc_id == labels.l_id, "left").select(
        F.col("doc_id").alias("id"),
        F.lit("file").alias("kind"),
        F.col("source").alias("module"),
        "lang",
        F.when(F.col("doc_id") % 11 == 0, "test").otherwise("domain").alias("role"),
        status.alias("status"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("smelly"),
        F.floor(F.col("n_chars") / 100).cast("long").alias("fan_in"),
    )


def every(t: Tables) -> DataFrame:
    """Files, rollups, features and the system: an upper document is as its parts are."""
    own = items(t)
    kids = own.select(
        F.explode(F.array(
            F.struct(F.lit("rollup").alias("kind"), F.col("module").alias("id"), F.col("module").alias("module")),
            F.struct(F.lit("feature").alias("kind"), F.concat_ws("/", "module", "lang").alias("id"), F.col("module").alias("module")),
            F.struct(F.lit("system").alias("kind"), F.lit("system").alias("id"), F.lit(".").alias("module")),
        )).alias("k"), "status",
    ).select("k.*", "status")
    status = F.when(F.bool_and(F.col("status") == "missing"), "missing").when(F.bool_or(F.col("status") != "current"), "stale").otherwise("current")
    folded = kids.groupBy("kind", "id", "module").agg(status.alias("status"))
    folded = folded.select("kind", "id", "module", F.lit("domain").alias("role"), "status", F.lit(False).alias("smelly"), F.lit(0).cast("long").alias("fan_in"))
    return own.select("kind", F.col("id").cast("string").alias("id"), "module", "role", "status", "smelly", "fan_in").unionByName(folded)


@query("a01_inventory", f"WITH {ALL_SQL} SELECT * FROM every")
def a01(t: Tables) -> DataFrame:
    return every(t)


@query("a02_summary", f"WITH {ITEMS_SQL} SELECT {SUMS_SQL} FROM items")
def a02(t: Tables) -> DataFrame:
    return C.summarize(items(t))


@query("a03_freshness", f"WITH {ITEMS_SQL}, s AS (SELECT lang, {SUMS_SQL} FROM items GROUP BY lang) SELECT lang, {RATIOS_SQL} FROM s")
def a03(t: Tables) -> DataFrame:
    return C.with_ratios(C.summarize(items(t), "lang")).select("lang", "freshness", "coverage")


@query("a04_coverage_ratio", f"WITH {ALL_SQL}, s AS (SELECT {SUMS_SQL} FROM every) SELECT {RATIOS_SQL} FROM s")
def a04(t: Tables) -> DataFrame:
    return C.with_ratios(C.summarize(every(t))).select("freshness", "coverage")


@query(
    "a05_weighted_freshness",
    f"""WITH {ITEMS_SQL} SELECT CASE WHEN count(*) FILTER (status <> 'missing') = 0 THEN 1.0
  WHEN coalesce(sum(fan_in) FILTER (status <> 'missing'), 0) = 0 THEN count(*) FILTER (status = 'current') / count(*) FILTER (status <> 'missing')
  ELSE coalesce(sum(fan_in) FILTER (status = 'current'), 0) / sum(fan_in) FILTER (status <> 'missing') END AS weighted_freshness FROM items""",
)
def a05(t: Tables) -> DataFrame:
    return C.weighted_freshness(items(t))


@query("a06_by_kind", f"WITH {ALL_SQL} SELECT kind, {SUMS_SQL} FROM every GROUP BY kind")
def a06(t: Tables) -> DataFrame:
    return C.summarize(every(t), "kind")


@query("a07_by_module", f"WITH {ITEMS_SQL}, s AS (SELECT module, {SUMS_SQL} FROM items GROUP BY module) SELECT *, {RATIOS_SQL} FROM s")
def a07(t: Tables) -> DataFrame:
    return C.with_ratios(C.summarize(items(t), "module"))


@query(
    "a10_file_status",
    """SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'R') THEN 'missing' WHEN bool_and(l_linestatus = 'F') THEN 'current' ELSE 'stale' END AS status
FROM lineitem GROUP BY l_orderkey""",
)
def a10(t: Tables) -> DataFrame:
    """A file is current only if all its parts are."""
    return R.file_status(t.lineitem, "l_orderkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")


@query(
    "a09_pending_generations",
    """SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'N' OR l_quantity > 45) + max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS generations
FROM lineitem GROUP BY l_orderkey""",
)
def a09(t: Tables) -> DataFrame:
    return R.pending_generations(t.lineitem, "l_orderkey", (F.col("l_returnflag") != "N") | (F.col("l_quantity") > 45), F.col("l_linestatus") == "O")


@query("p18_needs_attention", f"WITH {ITEMS_SQL} SELECT id, status, smelly FROM items WHERE status <> 'current' OR smelly")
def p18(t: Tables) -> DataFrame:
    return items(t).where(C.needs_attention(F.col("status"), F.col("smelly"))).select("id", "status", "smelly")


CUTOFF_SQL = """top AS (SELECT fan_in FROM items WHERE role = 'domain' AND fan_in >= 3 ORDER BY fan_in DESC LIMIT 8),
cut AS (SELECT greatest(3, CASE WHEN count(*) = 8 THEN min(fan_in) ELSE 3 END) AS cutoff FROM top)"""
PRIORITY_SQL = f"""WITH {ALL_SQL}, {CUTOFF_SQL}, pending AS (
  SELECT every.*, CASE WHEN kind = 'system' THEN 6 WHEN role = 'test' THEN 5 WHEN kind = 'rollup' THEN 3 WHEN kind = 'feature' THEN 1
    WHEN fan_in >= cutoff THEN 0 ELSE 2 END AS tier,
    CASE status WHEN 'missing' THEN 0 WHEN 'stale' THEN 1 ELSE 2 END AS urgency
  FROM every CROSS JOIN cut WHERE status <> 'current' OR smelly
)"""


@query("w07_nth_cutoff", f"WITH {ITEMS_SQL}, {CUTOFF_SQL} SELECT cutoff FROM cut")
def w07(t: Tables) -> DataFrame:
    return C.cutoff(items(t).where("role = 'domain'"))


@query("l01_prioritize", f"{PRIORITY_SQL} SELECT * FROM pending")
def l01(t: Tables) -> DataFrame:
    return C.prioritize(every(t))


@query("l02_top_impact", f"WITH {ITEMS_SQL} SELECT id, fan_in, status FROM items WHERE status <> 'current' OR smelly ORDER BY fan_in DESC, id LIMIT 5")
def l02(t: Tables) -> DataFrame:
    return C.top_stale(items(t)).select("id", "fan_in", "status")


@query("l03_page", f"{PRIORITY_SQL} SELECT id, tier, urgency FROM pending ORDER BY tier, urgency, fan_in DESC, id LIMIT 50 OFFSET 100")
def l03(t: Tables) -> DataFrame:
    return C.page(C.prioritize(every(t)), cursor=100).select("id", "tier", "urgency")


@query(
    "x03_coverage_report",
    f"""WITH {ALL_SQL}, g AS (
  SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(module) = 0 THEN 'module' ELSE 'all' END AS level,
         coalesce(kind, module, '') AS name, {SUMS_SQL} FROM every GROUP BY GROUPING SETS ((kind), (module), ())
) SELECT *, {RATIOS_SQL} FROM g""",
)
def x03(t: Tables) -> DataFrame:
    return C.coverage_report(every(t))


@query(
    "x07_four_case",
    f"""WITH {ITEMS_SQL} SELECT id, CASE WHEN status <> 'stale' AND NOT smelly THEN 'skip' WHEN status = 'stale' AND NOT smelly THEN 'regenerate'
  WHEN smelly AND status <> 'stale' THEN 'refresh_hashes' ELSE 'regenerate_with_prior' END AS action FROM items WHERE status <> 'missing'""",
)
def x07(t: Tables) -> DataFrame:
    from stratagraph.operators.staleness import reconcile

    return items(t).where("status <> 'missing'").select("id", reconcile(F.col("status") == "stale", F.col("smelly")).alias("action"))


@query(
    "x08_children_gate",
    f"WITH {ITEMS_SQL} SELECT module, bool_and(status = 'current') AS ready, count(*) FILTER (status <> 'current') AS blocking FROM items GROUP BY module",
)
def x08(t: Tables) -> DataFrame:
    """An upper document's task opens only when all its children are current."""
    return R.children_gate(items(t), "module", F.col("status") == "current")


@query(
    "x09_file_ladder",
    """SELECT doc_id, CASE WHEN pages <= 2 THEN 'raw' WHEN share >= 70 THEN 'outline' WHEN n_lines >= 8 THEN 'summaries' ELSE 'raw' END AS rung
FROM (SELECT doc_id, (strlen(text) + 3999) // 4000 AS pages, len(string_split(text, chr(10))) AS n_lines,
  least(100, 100 * list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) // greatest(1, strlen(text))) AS share FROM documents)""",
)
def x09(t: Tables) -> DataFrame:
    """How a file is shown: whole if small, an outline if one part dominates, summaries if it has many parts."""
    parts, size = F.split("text", "\n"), F.octet_length("text")
    share = F.least(F.lit(100), F.floor(100 * F.array_max(F.transform(parts, F.octet_length)) / F.greatest(size, F.lit(1))))
    return t.documents.select("doc_id", R.ladder(F.ceil(size / 4000), share, F.size(parts), most=2).alias("rung"))


@query(
    "a17_partly_read",
    """WITH f AS (SELECT doc_id, lang, length(text) - length(replace(text, '|', '')) AS errors FROM documents)
SELECT doc_id, errors, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS rank, (SELECT count(*) FROM f WHERE errors > 0) AS files,
  (SELECT sum(errors) FROM f)::BIGINT AS all_errors FROM f WHERE errors > 0 ORDER BY rank, errors DESC, doc_id LIMIT 10""",
)
def a17(t: Tables) -> DataFrame:
    """The ten worst partly read files (own code, then tests, then generated) beside the totals."""
    errors = (F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))).cast("long")
    f = t.documents.select("doc_id", "lang", errors.alias("errors"))
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2)
    return R.worst_read(f, "doc_id", "errors", rank)


@query("a18_generated_count", "SELECT count(*) FILTER (lang = 'fr') AS generated, count(*) AS files FROM documents")
def a18(t: Tables) -> DataFrame:
    return R.generated_count(t.documents, F.col("lang") == "fr")
