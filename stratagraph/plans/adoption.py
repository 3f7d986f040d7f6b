"""Adoption family: moved documents, vanished names, ancestors, sweeps; further text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import text as X
from stratagraph.operators import adopt as A
from stratagraph.operators import intervals as I
from stratagraph.operators import graph as G
from stratagraph.operators import reports as R
from stratagraph.plans.registry import Tables, query


@query(
    "x11_adoption_plan",
    """WITH d AS (SELECT doc_id AS id, source AS file, lang AS name, sha256(text) AS hash FROM documents),
old AS (SELECT * FROM d WHERE id % 4 = 0), live AS (SELECT * FROM d WHERE id % 4 <> 0),
met AS (SELECT old.id, old.name, live.id AS succ, live.name AS sn, max(CASE WHEN old.name = live.name THEN 1 ELSE 0 END) OVER (PARTITION BY old.id) AS named FROM old JOIN live USING (hash)),
one AS (SELECT id, count(*) AS n, min(succ) AS succ FROM met WHERE named = 0 OR name = sn GROUP BY id),
s AS (SELECT old.id, old.file, old.name, old.hash, one.n, CASE WHEN one.n = 1 THEN one.succ END AS successor FROM old LEFT JOIN one USING (id)),
v AS (SELECT s.file AS old_file, live.file AS new_file, count(*) AS votes FROM s JOIN live ON live.id = s.successor GROUP BY ALL),
b AS (SELECT old_file, max(votes) AS votes FROM v GROUP BY 1), w AS (SELECT old_file, min(new_file) AS winner FROM v JOIN b USING (old_file, votes) GROUP BY old_file HAVING count(*) = 1),
near AS (SELECT s.id, min(live.id) AS near FROM s JOIN w ON w.old_file = s.file JOIN live ON live.file = w.winner AND live.name = s.name AND live.hash = s.hash WHERE s.successor IS NULL GROUP BY s.id HAVING count(*) = 1),
r AS (SELECT s.id, s.file, s.n, coalesce(s.successor, near.near) AS successor FROM s LEFT JOIN near USING (id)),
c AS (SELECT successor FROM r WHERE successor IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT id, file, successor, CASE WHEN successor IS NULL AND n > 1 THEN 'ambiguous' WHEN successor IS NULL THEN 'gone' WHEN successor IN (SELECT successor FROM c) THEN 'claimed' ELSE 'adopt' END AS disposition FROM r""",
)
def x11(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("lang").alias("name"), F.sha2("text", 256).alias("hash"))
    return A.plan(d.where("id % 4 = 0"), d.where("id % 4 <> 0"))


@query(
    "j35_vanished_names",
    """WITH p AS (SELECT doc_id AS id, unnest(['lib/' || source || '.ts', source || '.ts', lang || '.md', 'x']) AS name FROM documents)
SELECT DISTINCT id, name FROM p WHERE name IN (SELECT unnest(['old/lib/' || source || '.ts', 'lib/' || source || '.ts', source || '.ts']) FROM documents WHERE source <> 'src3')
AND name NOT IN (SELECT unnest(['src/' || source || '.ts', source || '.ts']) FROM documents WHERE source IN ('src1', 'src2'))""",
)
def j35(t: Tables) -> DataFrame:
    d = t.documents
    prose = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("see lib/"), "source", F.lit(".ts and `"), "source", F.lit(".ts`, "), "lang", F.lit(".md, x")).alias("text"))
    gone = d.where("source <> 'src3'").select(F.concat(F.lit("old/lib/"), "source", F.lit(".ts")).alias("file")).distinct()
    live = d.where("source IN ('src1', 'src2')").select(F.concat(F.lit("src/"), "source", F.lit(".ts")).alias("file")).distinct()
    return A.vanished_names(prose, live, gone)


def containment(t: Tables) -> DataFrame:
    """Orders in customers, in nations, in regions."""
    row = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("id"), F.concat(F.lit(b), F.col(y).cast("string")).alias("parent"))
    return row(t.orders, "o", "o_orderkey", "c", "o_custkey").unionByName(row(t.customer, "c", "c_custkey", "n", "c_nationkey")).unionByName(row(t.nation, "n", "n_nationkey", "r", "n_regionkey"))


@query(
    "g05_ancestors",
    """WITH e AS (SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS parent FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation), b AS (SELECT e.id, f.parent AS ancestor FROM e JOIN e f ON e.parent = f.id), c AS (SELECT b.id, f.parent AS ancestor FROM b JOIN e f ON b.ancestor = f.id)
SELECT ancestor, count(*) AS below FROM (SELECT id, parent AS ancestor FROM e UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY ancestor""",
)
def g05(t: Tables) -> DataFrame:
    """Containment at every depth: how many lie below each node."""
    return I.below_counts(I.numbered(containment(t))).where("below > 0").select(F.col("id").alias("ancestor"), "below")


@query(
    "g06_enclosing_sums",
    """WITH o AS (SELECT o_custkey, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_custkey), c AS (SELECT c_nationkey, 'c' || c_custkey AS id, n, keys FROM customer JOIN o ON o_custkey = c_custkey),
n AS (SELECT n_regionkey, 'n' || n_nationkey AS id, sum(n)::BIGINT AS n, sum(keys)::BIGINT AS keys FROM c JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT id, n AS parts, keys FROM c UNION ALL SELECT id, n, keys FROM n UNION ALL SELECT 'r' || n_regionkey, sum(n)::BIGINT, sum(keys)::BIGINT FROM n GROUP BY n_regionkey UNION ALL SELECT 'o' || o_orderkey, 1, o_orderkey FROM orders""",
)
def g06(t: Tables) -> DataFrame:
    """What each enclosing node takes from all that lies below it, as sums over its interval."""
    points = t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(1).cast("long").alias("parts"), F.col("o_orderkey").alias("keys"))
    return I.sums_below(I.numbered(containment(t)), points, ["parts", "keys"])


@query(
    "g09_distances",
    """WITH RECURSIVE g AS (SELECT s_suppkey AS a, (s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier) AS b FROM supplier WHERE s_nationkey % 3 <> 0 UNION SELECT s_suppkey, s_suppkey + 1 FROM supplier WHERE s_nationkey % 4 = 1),
u AS (SELECT a, b FROM g WHERE a <> b UNION SELECT b, a FROM g WHERE a <> b), c(start, node) AS (SELECT a, a FROM u UNION SELECT c.start, u.b FROM c JOIN u ON u.a = c.node),
label AS (SELECT start AS node, min(node) AS component FROM c GROUP BY start), big AS (SELECT component FROM label GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
r(start, node, d) AS (SELECT node, node, 0 FROM label WHERE component = (SELECT component FROM big) UNION SELECT r.start, u.b, r.d + 1 FROM r JOIN u ON u.a = r.node WHERE r.d < 40),
m AS (SELECT start, node, min(d) AS d FROM r GROUP BY ALL) SELECT count(DISTINCT start) AS nodes, round(avg(d) FILTER (start <> node), 9) AS mean_distance, max(d) AS diameter FROM m""",
)
def g09(t: Tables) -> DataFrame:
    """All pairs of the largest component of a graph over all suppliers."""
    n = t.supplier.agg(F.count("*").alias("n"))  # one row
    k = F.col("s_suppkey")
    hop = t.supplier.where("s_nationkey % 3 <> 0").crossJoin(F.broadcast(n)).select(k.alias("a"), ((k * 3 + 1) % F.col("n")).alias("b"))
    edges = hop.unionByName(t.supplier.where("s_nationkey % 4 = 1").select(k.alias("a"), (k + 1).alias("b")))
    return G.distances(edges).select("nodes", F.round("mean_distance", 9).alias("mean_distance"), "diameter")


@query("x16_sweep", "WITH a AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_tax < 0.07), b AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.09) SELECT *, 'base' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'head' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def x16(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_partkey"]
    return A.sweep(t.lineitem.where("l_tax < 0.07").select(*keys), t.lineitem.where("l_discount < 0.09").select(*keys))


@query("f03_cap_marker", "SELECT p_partkey, CASE WHEN strlen(p_name || p_brand || p_type) <= 20 THEN p_name || p_brand || p_type ELSE left(p_name || p_brand || p_type, 17) || '...' END AS text FROM part")
def f03(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.cap_with_marker(F.concat("p_name", "p_brand", "p_type"), 20, "...").alias("text"))


@query("f04_leading_comment", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '// ' || source || chr(10) || '# ' || lang WHEN 1 THEN '' ELSE '/* ' || lang || ' */' END AS head FROM documents")
def f04(t: Tables) -> DataFrame:
    plain = F.concat(F.lit("// "), "source", F.lit("\n# "), "lang", F.lit("\n\n// no\nx = 1\n"))
    block = F.concat(F.lit("/* "), "lang", F.lit(" */\ny = 1\n// no\n"))
    text = F.when(F.col("doc_id") % 3 == 0, plain).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x = 1 // "), "source")).otherwise(block)
    return t.documents.select("doc_id", X.leading_comment(text).alias("head"))


@query("f05_strip_initialiser", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'const a' || p_partkey || ': Map<string, (x) => y>' WHEN 1 THEN 'let b' || p_brand ELSE 'c' || p_partkey || '(x == ' || p_size || ')' END AS head FROM part")
def f05(t: Tables) -> DataFrame:
    k, s = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("const a"), k, F.lit(": Map<string, (x) => y> = f(b == 1) || {c: 2}")))
        .when(F.col("p_size") % 3 == 1, F.concat(F.lit("let b"), "p_brand", F.lit(" = "), s))
        .otherwise(F.concat(F.lit("c"), k, F.lit("(x == "), s, F.lit(")")))
    )
    return t.part.select("p_partkey", X.stripped_initialiser(text).alias("head"))


@query("f11_strip_angles", "SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN 'Map ' || p_name || ' x' ELSE p_name || p_brand END AS text FROM part")
def f11(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.stripped_angles(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Map<K, List<V>> "), "p_name", F.lit("<A<B<C>>> x"))).otherwise(F.concat("p_name", F.lit("<<"), "p_type", F.lit(">>"), "p_brand"))).alias("text"))


@query("f15_link_destination", "SELECT p_partkey, replace(replace(replace(p_name || '/(a) [' || p_type || ']%.md', '%', '%25'), ' ', '%20'), '(', '%28').replace(')', '%29').replace('[', '%5B').replace(']', '%5D') AS link FROM part")
def f15(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.link_destination(F.concat("p_name", F.lit("/(a) ["), "p_type", F.lit("]%.md"))).alias("link"))


@query("f18_provenance", f"SELECT doc_id, '# ' || source || chr(10) || '{X.PROVENANCE}' || chr(10) || 'body' AS made, '# ' || source || chr(10) || 'body' AS plain FROM documents")
def f18(t: Tables) -> DataFrame:
    made = X.with_provenance(X.with_provenance(F.concat(F.lit("# "), "source", F.lit("\nbody"))))
    return t.documents.select("doc_id", made.alias("made"), X.without_provenance(made).alias("plain"))


@query(
    "f22_container_outline",
    """SELECT conv_id, CASE WHEN sum(strlen(text)) > 600 THEN string_agg(role || ' ' || left(text, 20), chr(10) ORDER BY turn) ELSE string_agg(text, chr(10) ORDER BY turn) END AS shown FROM conversations GROUP BY conv_id""",
)
def f22(t: Tables) -> DataFrame:
    """Signatures instead of bodies when a container is large."""
    return R.outline(t.conversations, "conv_id", "turn", F.concat_ws(" ", "role", F.substring("text", 1, 20)), "text", 600)


@query(
    "x02_document_state",
    """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN sha256(d.text) = sha256(CASE WHEN l.quality = 0 THEN d.text || '!' ELSE d.text END) THEN 'current' ELSE 'stale' END AS status,
  CASE WHEN l.quality = 0 THEN 'changed:source' ELSE '' END AS changed FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def x02(t: Tables) -> DataFrame:
    """A document's state by its recorded hash: missing, current or stale, and what changed."""
    from stratagraph.operators.staleness import hash_diff

    d = t.documents.select("doc_id", "text")
    stored = d.join(t.labels.select("doc_id", "quality"), "doc_id").select("doc_id", F.sha2(F.when(F.col("quality") == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    diff = hash_diff(d.select("doc_id", F.sha2("text", 256).alias("hash")), stored, ["doc_id"])
    status = F.when(F.col("action") == "added", "missing").when(F.col("action").isNull(), "current").otherwise("stale")
    return d.select("doc_id").join(diff, "doc_id", "left").select("doc_id", status.alias("status"), F.when(F.col("action") == "changed", "changed:source").otherwise("").alias("changed"))


@query("a29_fold_cost", "SELECT l_partkey, count(DISTINCT l_orderkey) AS importers, count(*) FILTER (l_quantity > 25) AS naming FROM lineitem GROUP BY l_partkey")
def a29(t: Tables) -> DataFrame:
    return R.fold_cost(t.lineitem, "l_partkey", "l_orderkey", F.col("l_quantity") > 25)


@query("a30_migration_report", "SELECT CASE WHEN l.doc_id IS NULL THEN 'unreadable' WHEN l.quality = 1 THEN 'migrated' ELSE 'skipped' END AS outcome, count(*) AS documents FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def a30(t: Tables) -> DataFrame:
    """Only documents that were current move to the new hash."""
    labels = t.labels.select(F.col("doc_id").alias("l_id"), "quality")
    d = t.documents.select("doc_id").join(labels, F.col("doc_id") == F.col("l_id"), "left")
    outcome = F.when(F.col("l_id").isNull(), "unreadable").when(F.col("quality") == 1, "migrated").otherwise("skipped")
    return R.counts_of(d, outcome, "outcome")


@query(
    "j36_document_links",
    """SELECT doc_id, CASE WHEN source = 'src1' THEN '' ELSE '../../src1/' END
  || CASE WHEN source = 'src1' AND lang = 'en' THEN '' WHEN source = 'src1' THEN '../en/' ELSE 'en/' END || 'a.md#part' AS link FROM documents""",
)
def j36(t: Tables) -> DataFrame:
    """Relative links between documents of different folders, to a section."""
    from stratagraph.functions.paths import relative_link

    here = F.concat_ws("/", "source", "lang", F.lit("x.md"))
    return t.documents.select("doc_id", relative_link(here, F.lit("src1/en/a.md"), F.lit("part")).alias("link"))
