"""Staleness family: recorded against current hashes, orphans, moved documents, causes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import hashing as H
from stratagraph.operators import merkle as M
from stratagraph.operators import reports as R
from stratagraph.operators import staleness as S
from stratagraph.plans.registry import Tables, query

# The older snapshot: every 9th document has another text, every 13th is absent; ids from 1,000,000 on are gone since.
OLD_SQL = """old AS (
  SELECT doc_id, sha256(CASE WHEN doc_id % 9 = 0 THEN text || ' old' ELSE text END) AS hash FROM documents WHERE doc_id % 13 <> 0
  UNION ALL SELECT doc_id + 1000000, sha256(text) FROM documents WHERE doc_id % 17 = 0
), now AS (SELECT doc_id, sha256(text) AS hash FROM documents)"""


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.documents.select("doc_id", "text")
    old_text = F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    old = d.where("doc_id % 13 <> 0").select("doc_id", H.stable(old_text).alias("hash"))
    gone = d.where("doc_id % 17 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), H.stable(F.col("text")).alias("hash"))
    return d.select("doc_id", H.stable(F.col("text")).alias("hash")), old.unionByName(gone)


@query(
    "j22_hash_diff",
    f"""WITH {OLD_SQL} SELECT coalesce(now.doc_id, old.doc_id) AS doc_id,
  CASE WHEN old.doc_id IS NULL THEN 'added' WHEN now.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS action
FROM now FULL JOIN old ON now.doc_id = old.doc_id WHERE now.hash IS DISTINCT FROM old.hash""",
)
def j22(t: Tables) -> DataFrame:
    return S.hash_diff(*snapshots(t), ["doc_id"])


@query(
    "st4_catch_up",
    f"""WITH {OLD_SQL}, d AS (SELECT CASE WHEN old.doc_id IS NULL THEN 'added' WHEN now.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS action
FROM now FULL JOIN old ON now.doc_id = old.doc_id WHERE now.hash IS DISTINCT FROM old.hash) SELECT action, count(*) AS files FROM d GROUP BY action""",
)
def st4(t: Tables) -> DataFrame:
    return S.hash_diff(*snapshots(t), ["doc_id"]).groupBy("action").agg(F.count("*").alias("files"))


@query("p19_in_sync", f"WITH {OLD_SQL} SELECT now.doc_id, now.hash = old.hash AS in_sync FROM now JOIN old USING (doc_id)")
def p19(t: Tables) -> DataFrame:
    now, old = snapshots(t)
    return R.in_sync(now, old, "doc_id")


@query("j31_orphans", f"WITH {OLD_SQL} SELECT doc_id FROM old WHERE doc_id NOT IN (SELECT doc_id FROM now)")
def j31(t: Tables) -> DataFrame:
    now, old = snapshots(t)
    return S.orphans(old, now, "doc_id").select("doc_id")


@query("t03_except", f"WITH {OLD_SQL} SELECT doc_id FROM old EXCEPT SELECT doc_id FROM now")
def t03(t: Tables) -> DataFrame:
    now, old = snapshots(t)
    return old.select("doc_id").exceptAll(now.select("doc_id")).distinct()


@query(
    "j32_orphan_sections",
    """SELECT c.conv_id, c.turn FROM conversations c WHERE c.conv_id IN (SELECT doc_id FROM documents)
AND NOT EXISTS (SELECT 1 FROM conversations k WHERE k.conv_id = c.conv_id AND k.turn = c.turn AND k.role <> 'user')""",
)
def j32(t: Tables) -> DataFrame:
    """Stored sections of live files whose symbol is gone."""
    stored, live = t.conversations.select("conv_id", "turn"), t.documents.select(F.col("doc_id").alias("conv_id"))
    return S.orphans(stored.join(live, "conv_id", "left_semi"), t.conversations.where("role <> 'user'").select("conv_id", "turn"), ["conv_id", "turn"])


@query(
    "j33_successor",
    """WITH old AS (SELECT doc_id AS id, source AS name, sha256(text) AS hash FROM documents WHERE doc_id % 4 = 0),
live AS (SELECT doc_id AS id, source AS name, sha256(text) AS hash FROM documents WHERE doc_id % 4 <> 0),
met AS (SELECT old.id, old.name, live.id AS succ, live.name AS succ_name, max(CASE WHEN old.name = live.name THEN 1 ELSE 0 END) OVER (PARTITION BY old.id) AS named
  FROM old JOIN live USING (hash)),
one AS (SELECT id, count(*) AS n, min(succ) AS succ, max(named) AS named FROM met WHERE named = 0 OR name = succ_name GROUP BY id)
SELECT id, CASE WHEN n = 1 THEN succ END AS successor, CASE WHEN n > 1 THEN 'ambiguous' WHEN named = 1 THEN 'same_name' ELSE 'renamed' END AS how FROM one""",
)
def j33(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("name"), H.stable(F.col("text")).alias("hash"))
    return S.successors(d.where("id % 4 = 0"), d.where("id % 4 <> 0"))


@query(
    "j34_multiset_compare",
    """WITH now AS (SELECT l_orderkey AS g, l_quantity AS v, count(*) AS n FROM lineitem WHERE l_orderkey % 3 <> 1 OR l_tax > 0.02 GROUP BY ALL),
old AS (SELECT l_orderkey AS g, l_quantity AS v, count(*) AS o FROM lineitem WHERE l_discount < 0.09 GROUP BY ALL)
SELECT coalesce(now.g, old.g) AS l_orderkey, CASE WHEN bool_and(coalesce(n, 0) = coalesce(o, 0)) THEN 'equal'
  WHEN bool_and(coalesce(n, 0) >= coalesce(o, 0)) THEN 'added' ELSE 'changed' END AS outcome
FROM now FULL JOIN old ON now.g = old.g AND now.v = old.v GROUP BY 1""",
)
def j34(t: Tables) -> DataFrame:
    lines = t.lineitem
    return S.multiset_compare(lines.where("l_orderkey % 3 <> 1 OR l_tax > 0.02"), lines.where("l_discount < 0.09"), "l_orderkey", "l_quantity")


@query("t06_multiset_except", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_tax < 0.05 EXCEPT ALL SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.05")
def t06(t: Tables) -> DataFrame:
    lines = t.lineitem
    keys = ["l_orderkey", "l_partkey"]
    return lines.where("l_tax < 0.05").select(*keys).exceptAll(lines.where("l_discount < 0.05").select(*keys))


@query(
    "a20_lineage_vote",
    """WITH v AS (SELECT o_custkey AS old_file, o_orderpriority AS new_file, count(*) AS votes FROM orders GROUP BY ALL),
b AS (SELECT old_file, max(votes) AS votes FROM v GROUP BY old_file)
SELECT old_file, CASE WHEN count(*) = 1 THEN min(new_file) END AS winner, max(votes) AS votes FROM v JOIN b USING (old_file, votes) GROUP BY old_file""",
)
def a20(t: Tables) -> DataFrame:
    return S.lineage_vote(t.orders.select(F.col("o_custkey").alias("old_file"), F.col("o_orderpriority").alias("new_file")), "old_file", "new_file")


@query("a21_claimed", "SELECT o_custkey AS successor, count(*) AS claims FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 HAVING count(*) > 1")
def a21(t: Tables) -> DataFrame:
    return S.claimed(t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("successor")))


CAUSE_SQL = """c AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'removed' WHEN 'A' THEN 'added' ELSE CASE l_linestatus WHEN 'F' THEN 'source' ELSE 'dependency' END END AS cause FROM lineitem),
label AS (SELECT l_orderkey, string_agg(DISTINCT cause, ' + ' ORDER BY cause) AS label FROM c GROUP BY l_orderkey)"""


def causes(t: Tables) -> DataFrame:
    cause = F.when(F.col("l_returnflag") == "R", "removed").when(F.col("l_returnflag") == "A", "added").when(F.col("l_linestatus") == "F", "source").otherwise("dependency")
    return t.lineitem.select("l_orderkey", cause.alias("cause"))


@query("a13_cause_label", f"WITH {CAUSE_SQL} SELECT l_orderkey, label FROM label")
def a13(t: Tables) -> DataFrame:
    return S.cause_label(causes(t), "l_orderkey", "cause")


@query("a12_cause_counts", f"WITH {CAUSE_SQL} SELECT label, count(*) AS documents FROM label GROUP BY label")
def a12(t: Tables) -> DataFrame:
    return S.cause_label(causes(t), "l_orderkey", "cause").groupBy("label").agg(F.count("*").alias("documents"))


@query("l05_top_targets", "SELECT l_partkey, count(*) AS causes FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY causes DESC, l_partkey LIMIT 10")
def l05(t: Tables) -> DataFrame:
    return R.top_counts(t.lineitem.where("l_returnflag = 'R'"), "l_partkey", "causes")


@query("a14_coarse_distinct", "SELECT count(DISTINCT (l_orderkey, l_partkey)) AS dependants FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 40")
def a14(t: Tables) -> DataFrame:
    big = t.part.where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return R.distinct_dependants(t.lineitem, big, "l_orderkey", "l_partkey")


def _chunks_sql(fan: int, levels: int = 7) -> str:
    """SQL for hashes over chunks, each level stated; enough for ``fan ** (levels + 1)`` lines a group."""
    base = "l0 AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id, sha256(text)) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, sha256(text) AS line FROM documents WHERE text IS NOT NULL)"
    up = "l{1} AS (SELECT * FROM l{0} WHERE n <= {2} UNION ALL SELECT lang, pos // {2}, (n + {2} - 1) // {2}, sha256(string_agg(line, chr(10) ORDER BY pos)) FROM l{0} WHERE n > {2} GROUP BY ALL)"
    steps = [up.format(i, i + 1, fan) for i in range(levels)]
    return f"WITH {', '.join([base, *steps])} SELECT lang, sha256('lang ' || lang || chr(10) || string_agg(line, chr(10) ORDER BY pos)) AS hash FROM l{levels} GROUP BY lang"


@query(
    "a15_merkle",
    """SELECT conv_id, sha256('conv ' || conv_id || coalesce(chr(10) || string_agg(sha256(text), chr(10) ORDER BY turn), '')) AS hash FROM conversations GROUP BY conv_id""",
)
def a15(t: Tables) -> DataFrame:
    head = F.concat(F.lit("conv "), F.col("conv_id").cast("string"))
    return M.hashed_lines(t.conversations, "conv_id", ["turn"], H.stable(F.col("text")), "hash", head)


@query("a15_merkle_chunks", _chunks_sql(16))
def a15_chunks(t: Tables) -> DataFrame:
    """Large groups: every language's documents, hashed over chunks of 16, level by level."""
    return M.hashed_lines(t.documents, "lang", ["doc_id"], H.stable(F.col("text")), "hash", F.concat(F.lit("lang "), "lang"), 16)


@query(
    "a16_deps_hash",
    """WITH p AS (SELECT DISTINCT l_orderkey, l_partkey, p_name AS h FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, sha256(string_agg(l_partkey || ':' || h, chr(10) ORDER BY l_partkey, h)) AS deps_hash FROM p GROUP BY l_orderkey""",
)
def a16(t: Tables) -> DataFrame:
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("h"))
    pairs = t.lineitem.select("l_orderkey", "l_partkey").join(part, "l_partkey").distinct()
    return M.hashed_lines(pairs, "l_orderkey", ["l_partkey", "h"], F.concat_ws(":", "l_partkey", "h"), "deps_hash")


@query(
    "j28_participant_hashes",
    """SELECT 'core' AS tier, o_orderkey AS target, sha256(o_orderpriority) AS hash FROM orders
UNION ALL SELECT 'dependencies', p_partkey, sha256(CASE WHEN p_size > 25 THEN p_name ELSE p_brand END) FROM part
UNION ALL SELECT 'data', s_suppkey, sha256(s_name) FROM supplier""",
)
def j28(t: Tables) -> DataFrame:
    """Core by source, dependencies by interface where there is one, data by source."""
    interface = F.coalesce(F.when(F.col("p_size") > 25, F.col("p_name")), F.col("p_brand"))
    tiers = {"core": (t.orders, "o_orderkey", F.col("o_orderpriority")), "dependencies": (t.part, "p_partkey", interface), "data": (t.supplier, "s_suppkey", F.col("s_name"))}
    return R.tier_hashes(tiers, H.stable)


@query(
    "j30_child_hashes",
    f"""WITH {OLD_SQL} SELECT d.source, d.doc_id, CASE WHEN old.hash IS NULL OR old.hash <> now.hash THEN '' ELSE old.hash END AS child_hash
FROM documents d JOIN now USING (doc_id) LEFT JOIN old USING (doc_id)""",
)
def j30(t: Tables) -> DataFrame:
    """A child's recorded hash, blank if it is missing or has changed."""
    now, old = snapshots(t)
    return R.child_hashes(t.documents.select("source", "doc_id"), now, old, "doc_id").select("source", "doc_id", "child_hash")


@query(
    "g04_nested_explanation",
    """WITH f AS (SELECT source, lang, count(*) AS files FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY ALL),
m AS (SELECT source, string_agg(lang || '=' || files, ',' ORDER BY lang) AS because, sum(files)::BIGINT AS files FROM f GROUP BY source)
SELECT 'system' AS document, source AS cause, files, because FROM m""",
)
def g04(t: Tables) -> DataFrame:
    """System to folder to file causes: three levels of grouping."""
    bad = t.labels.where("quality = 0").select("doc_id")
    return R.nested_causes(t.documents.join(bad, "doc_id"), "source", "lang")


@query(
    "a19_disposition_counts",
    """WITH d AS (SELECT CASE WHEN l.doc_id IS NULL THEN 'regenerate' WHEN l.toxic = 1 THEN 'rejected' WHEN l.quality = 1 THEN 'adopted' ELSE 'unresolved' END AS disposition
FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT disposition, count(*) AS documents FROM d GROUP BY 1""",
)
def a19(t: Tables) -> DataFrame:
    labels = t.labels.select(F.col("doc_id").alias("l_id"), "toxic", "quality")
    d = t.documents.select("doc_id").join(labels, F.col("doc_id") == F.col("l_id"), "left")
    what = F.when(F.col("l_id").isNull(), "regenerate").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "adopted").otherwise("unresolved")
    return R.counts_of(d, what, "disposition")
