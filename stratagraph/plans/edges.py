"""Edge family: lineitem as references from orders to parts, pages' links, part chains as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import graph as G
from stratagraph.operators import reachability
from stratagraph.operators import reports as P
from stratagraph.operators import resolve as R
from stratagraph.plans.registry import Tables, query
from stratagraph.staging import checkpointed


def refs(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber")


def known(t: Tables) -> DataFrame:
    return t.part.where("p_size <= 45").select("p_partkey")


@query("j01_callers", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7')")
def j01(t: Tables) -> DataFrame:
    return G.callers(t.part.where("p_brand = 'Brand#7'"), refs(t), "p_partkey", "l_partkey").select("l_partkey", "l_orderkey", "l_linenumber")


@query("j02_callees_left", "SELECT l_orderkey, l_partkey, l_linenumber, p_partkey AS resolved FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size <= 45")
def j02(t: Tables) -> DataFrame:
    return G.callees(refs(t), known(t), "p_partkey", "l_partkey")


@query("j04_default_imports", "SELECT l_orderkey, p_name AS target FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber = 1 AND p_size <= 45")
def j04(t: Tables) -> DataFrame:
    part = t.part.where("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("target"))
    return P.default_targets(t.lineitem.where("l_linenumber = 1"), part, "l_partkey", "l_orderkey", "target")


@query(
    "j06_new_edges_anti",
    """SELECT DISTINCT l_orderkey, l_partkey FROM lineitem l WHERE l_returnflag = 'R'
AND NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_returnflag = 'A' AND k.l_orderkey = l.l_orderkey AND k.l_partkey = l.l_partkey)""",
)
def j06(t: Tables) -> DataFrame:
    lines = t.lineitem
    return G.new_edges(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), ["l_orderkey", "l_partkey"])


@query("j07_same_file_self_join", "SELECT DISTINCT a.l_orderkey, a.l_linenumber AS impl, b.l_linenumber AS type FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'N'")
def j07(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_returnflag")
    impl = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("impl"))
    kind = lines.where("l_returnflag = 'N'").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("type"))
    return P.same_file_pairs(impl, kind, ["l_orderkey", "l_suppkey"], "l_orderkey").select("l_orderkey", "impl", "type")


PATH_SQL = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def page_paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))


@query(
    "j08_suffix_join",
    f"""WITH p AS (SELECT page_id, {PATH_SQL} AS path FROM pages),
s AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(list_slice(string_split(path, '/'), i, len(string_split(path, '/'))), '/'))) AS suffix FROM p),
m AS (SELECT suffix, min(path) AS target FROM s GROUP BY suffix), w AS (SELECT page_id, lang || '/' || page_id AS suffix FROM p CROSS JOIN (SELECT DISTINCT lang FROM documents))
SELECT w.page_id, w.suffix, m.target FROM w LEFT JOIN m USING (suffix)""",
)
def j08(t: Tables) -> DataFrame:
    langs = t.documents.select("lang").distinct()  # a handful of languages
    wanted = t.pages.select("page_id").crossJoin(F.broadcast(langs)).select("page_id", F.concat_ws("/", "lang", "page_id").alias("suffix"))
    return R.suffix_join(wanted, page_paths(t)).select("page_id", "suffix", "target")


@query(
    "j11_unique_suffix",
    f"""WITH p AS (SELECT {PATH_SQL} AS path FROM pages),
s AS (SELECT path, unnest(list_transform(range(1, len(string_split(path, '/')) + 1), lambda i: array_to_string(list_slice(string_split(path, '/'), i, len(string_split(path, '/'))), '/'))) AS suffix FROM p)
SELECT suffix, min(path) AS target FROM s GROUP BY suffix HAVING count(*) = 1""",
)
def j11(t: Tables) -> DataFrame:
    return R.unique_suffix(page_paths(t))


HREF_SQL = "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages"


def hrefs(t: Tables) -> DataFrame:
    return P.link_literals(t.pages, "page_id", "html", 'href="([^"]*)"').withColumnRenamed("literal", "href")


@query("e16_link_literals", f"WITH h AS ({HREF_SQL}) SELECT href, count(*) AS links, count(DISTINCT page_id) AS pages FROM h GROUP BY href")
def e16(t: Tables) -> DataFrame:
    return hrefs(t).groupBy("href").agg(F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"))


@query("e18_distinct_tags", "SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)))::VARCHAR AS tags FROM pages")
def e18(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.concat(F.lit("["), F.array_join(P.distinct_tags(F.col("html")), ", "), F.lit("]")).alias("tags"))


@query(
    "j14_route_pattern",
    """WITH u AS (SELECT DISTINCT '/' || lang || '/' || source AS path FROM documents),
r AS (SELECT DISTINCT '/' || lang || '/[id]' AS pattern, 1 AS ord FROM documents WHERE lang <> 'fr' UNION SELECT '/en/src1', 0 UNION SELECT '/[lang]/src2', 2 UNION SELECT '/fr/src3/x', 0),
m AS (SELECT path, pattern, ord FROM u JOIN r ON regexp_full_match(path, regexp_replace(pattern, '\\[[^/]*\\]', '[^/]+', 'g')))
SELECT path, arg_min(pattern, {'o': ord, 'p': pattern}) AS pattern FROM m GROUP BY path""",
)
def j14(t: Tables) -> DataFrame:
    d = t.documents
    paths = d.select(F.concat(F.lit("/"), "lang", F.lit("/"), "source").alias("path")).distinct()
    routes = d.where("lang <> 'fr'").select(F.concat(F.lit("/"), "lang", F.lit("/[id]")).alias("pattern"), F.lit(1).alias("ord")).distinct()
    fixed = t.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(o).alias("ord")) for p, o in (("/en/src1", 0), ("/[lang]/src2", 2), ("/fr/src3/x", 0))])).alias("r")).select("r.*")
    return R.route_join(paths, routes.unionByName(fixed))


@query("j15_table_refs", "SELECT event_type AS name, min(target) AS target FROM events JOIN (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'purchase' WHEN 'MACHINERY' THEN 'click' ELSE lower(c_mktsegment) END AS tab, c_custkey AS target FROM customer) c ON c.tab = event_type GROUP BY 1")
def j15(t: Tables) -> DataFrame:
    """The first schema symbol whose last id part equals the name; names that no table has stay out."""
    names = t.events.select(F.col("event_type").alias("name")).distinct()
    table = F.when(F.col("c_mktsegment") == "BUILDING", "purchase").when(F.col("c_mktsegment") == "MACHINERY", "click").otherwise(F.lower("c_mktsegment"))
    return P.named_tables(names, t.customer.select(table.alias("table"), "c_custkey"), "name", "table", "c_custkey")


@query(
    "j17_coalesce_join",
    """WITH own AS (SELECT n_name AS name, min(c_custkey) AS target FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0 GROUP BY 1),
imported AS (SELECT n_name AS name, min(s_suppkey) AS target FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 2 = 0 GROUP BY 1),
anywhere AS (SELECT n_name AS name, n_nationkey::BIGINT AS target FROM nation)
SELECT n.n_name AS name, coalesce(o.target, i.target, a.target) AS target FROM nation n LEFT JOIN own o ON o.name = n.n_name LEFT JOIN imported i ON i.name = n.n_name LEFT JOIN anywhere a ON a.name = n.n_name""",
)
def j17(t: Tables) -> DataFrame:
    """The own file's declaration, else what it imports under the name, else the smallest declaring file."""
    n = t.nation.select("n_nationkey", F.col("n_name").alias("name"))
    own = t.customer.join(F.broadcast(n.where("n_nationkey % 3 = 0")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("name").agg(F.min("c_custkey").alias("target"))
    imported = t.supplier.join(F.broadcast(n.where("n_nationkey % 2 = 0")), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("name").agg(F.min("s_suppkey").alias("target"))
    anywhere = n.select("name", F.col("n_nationkey").cast("long").alias("target"))
    return R.coalesce_join(n.select("name"), [own, imported, anywhere], "name", "target")


CHASE_SQL = """WITH imp AS (SELECT DISTINCT l_partkey AS k FROM lineitem),
d AS (SELECT p_partkey AS k FROM part WHERE p_size > 40), n AS (SELECT count(*) AS n FROM part), hop AS (SELECT p_partkey AS k, (p_partkey * 7 + 3) % n AS nxt FROM part, n),
h0 AS (SELECT k AS start, k FROM imp),
h1 AS (SELECT start, nxt AS k FROM h0 JOIN hop USING (k) WHERE k NOT IN (SELECT k FROM d)),
h2 AS (SELECT start, nxt AS k FROM h1 JOIN hop USING (k) WHERE k NOT IN (SELECT k FROM d)),
h3 AS (SELECT start, nxt AS k FROM h2 JOIN hop USING (k) WHERE k NOT IN (SELECT k FROM d)),
every AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2 UNION ALL SELECT * FROM h3)
SELECT start, k AS id FROM every WHERE k IN (SELECT k FROM d)"""


@query("j03_reexport_chase", CHASE_SQL)
def j03(t: Tables) -> DataFrame:
    """Follow re-exports, at most three hops, to the declaring file."""
    n = t.part.agg(F.count("*").alias("n"))  # one row
    part = t.part.select("p_partkey", "p_size")
    name = F.lit("x").alias("name")
    imports = t.lineitem.select(F.col("l_partkey").alias("start")).distinct().select("start", F.col("start").alias("file"), name)
    declared = part.where("p_size > 40").select(F.col("p_partkey").alias("file"), name, F.col("p_partkey").alias("id"))
    hop = part.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("file"), name, ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("to_file"), F.lit("x").alias("to_name"))
    return R.reexport_chase(imports, declared, hop, 3).select("start", "id")


@query(
    "j12_word_join",
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS name FROM documents),
r AS (SELECT doc_id, lang AS header FROM documents), offered(header, name) AS (VALUES ('en', 'The'), ('en', 'and'), ('de', 'und'), ('de', 'der'), ('fr', 'les'), ('es', 'que'), ('es', 'the'))
SELECT r.doc_id AS file, offered.header, offered.name FROM r JOIN offered USING (header) JOIN w ON w.doc_id = r.doc_id AND w.name = offered.name""",
)
def j12(t: Tables) -> DataFrame:
    from stratagraph.functions.text import words

    d = t.documents
    pairs = [("en", "The"), ("en", "and"), ("de", "und"), ("de", "der"), ("fr", "les"), ("es", "que"), ("es", "the")]
    offered = t.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(h).alias("header"), F.lit(n).alias("name")) for h, n in pairs])).alias("o")).select("o.*")
    reached = d.select(F.col("doc_id").alias("file"), F.col("lang").alias("header"), words(F.col("text")).alias("words"))
    return R.words_written(reached, F.broadcast(offered)).select("file", "header", "name")  # seven names


@query(
    "j13_unique_shallowest",
    """WITH c AS (SELECT l_orderkey, l_linenumber AS depth, l_suppkey FROM lineitem), m AS (SELECT l_orderkey, min(depth) AS depth FROM c GROUP BY 1)
SELECT l_orderkey, min(l_suppkey) AS l_suppkey FROM c JOIN m USING (l_orderkey, depth) GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1""",
)
def j13(t: Tables) -> DataFrame:
    """The innermost candidate pairs only if it is the only one at its depth."""
    return R.unique_shallowest(t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("depth"), "l_suppkey"), "l_orderkey", "depth", "l_suppkey")


@query(
    "j25_scoped_deps",
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_$]+')) AS word FROM documents),
imports AS (SELECT doc_id, source AS target, CASE lang WHEN 'en' THEN 'the' WHEN 'de' THEN 'und' WHEN 'fr' THEN 'les' ELSE 'que' END AS word FROM documents)
SELECT i.doc_id, i.target FROM imports i JOIN w USING (doc_id, word) WHERE i.target IS DISTINCT FROM 'src' || (i.doc_id % 7)""",
)
def j25(t: Tables) -> DataFrame:
    """Imports whose name a part's text writes as a whole word, itself excluded."""
    from stratagraph.functions.text import words

    d = t.documents
    name = F.when(F.col("lang") == "en", "the").when(F.col("lang") == "de", "und").when(F.col("lang") == "fr", "les").otherwise("que")
    imports = d.select("doc_id", F.col("source").alias("target"), name.alias("word"), words(F.col("text")).alias("words"))
    itself = F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string"))
    return R.scoped_by_words(imports, "word", "words", "target", itself).select("doc_id", "target")


@query("j26_externals", f"WITH h AS ({HREF_SQL}) SELECT page_id, regexp_extract(href, '^[^/:]*[/:]*([^/:]*)', 1) AS package, count(*) AS uses FROM h GROUP BY ALL")
def j26(t: Tables) -> DataFrame:
    return P.externals(hrefs(t), "page_id", F.col("href"))


@query("j27_file_dependencies", "SELECT DISTINCT l_orderkey, l_partkey, p_brand AS hash FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 45")
def j27(t: Tables) -> DataFrame:
    part = t.part.where("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("hash"))
    return P.file_dependencies(t.lineitem, part, "l_orderkey", "l_partkey", "hash")


@query(
    "j29_dependency_context",
    """SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, o_orderpriority || ' / ' || o_orderstatus) AS context
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def j29(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("summary"))
    fallback = F.concat_ws(" / ", "o_orderpriority", "o_orderstatus")
    return P.dependency_context(t.orders, c, F.col("o_custkey") == F.col("c_custkey"), "summary", fallback).select("o_orderkey", "context")


@query(
    "j37_accuracy",
    """WITH f AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.07), t AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_tax < 0.06),
c AS (SELECT count(f.l_orderkey) AS found, count(t.l_orderkey) AS truth, count(*) FILTER (f.l_orderkey IS NOT NULL AND t.l_orderkey IS NOT NULL) AS both FROM f FULL JOIN t ON f.l_orderkey = t.l_orderkey AND f.l_partkey = t.l_partkey)
SELECT found, truth, "both", "both" / truth AS recall, "both" / found AS precision FROM c""",
)
def j37(t: Tables) -> DataFrame:
    lines = t.lineitem
    return R.accuracy(lines.where("l_discount < 0.07"), lines.where("l_tax < 0.06"), ["l_orderkey", "l_partkey"])


@query("a08_fan_in", "SELECT l_partkey, count(*) AS fan_in FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_partkey")
def a08(t: Tables) -> DataFrame:
    return G.fan_in(t.lineitem, "l_partkey", F.col("l_returnflag") != "R")


@query(
    "a25_edge_statistics",
    """SELECT l_returnflag AS kind, count(*) AS total, count(p_partkey) AS resolved, count(DISTINCT l_orderkey) AS files FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size <= 45 GROUP BY 1""",
)
def a25(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_returnflag", "l_orderkey", "l_partkey")
    edges = G.callees(lines, known(t), "p_partkey", "l_partkey")
    return edges.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("total"), F.count("resolved").alias("resolved"), F.count_distinct("l_orderkey").alias("files"))


# A graph of all parts without walls: hops across the table, chains, and a hub that every fiftieth size leads to.
HUB_SQL = """g AS (SELECT p_partkey AS a, (p_partkey * 3 + 1) % (SELECT count(*) FROM part) AS b FROM part WHERE p_size % 3 = 0
  UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_size > 30 AND p_partkey + 1 < (SELECT count(*) FROM part) UNION SELECT p_partkey, 0 FROM part WHERE p_size % 25 = 0
  UNION SELECT p_partkey, p_partkey - 1 FROM part WHERE p_size % 10 = 1 AND p_partkey > 0)"""


def hub_graph(t: Tables) -> DataFrame:
    part, k = t.part.select("p_partkey", "p_size"), F.col("p_partkey")
    n = t.part.agg(F.count("*").alias("n"))  # one row
    sized = part.crossJoin(F.broadcast(n))
    hop = sized.where("p_size % 3 = 0").select(k.alias("a"), ((k * 3 + 1) % F.col("n")).alias("b"))
    step = sized.where((F.col("p_size") > 30) & (k + 1 < F.col("n"))).select(k.alias("a"), (k + 1).alias("b"))
    back = part.where("p_size % 10 = 1 AND p_partkey > 0").select(k.alias("a"), (k - 1).alias("b"))  # cycles
    return hop.unionByName(step).unionByName(back).unionByName(part.where("p_size % 25 = 0").select(k.alias("a"), F.lit(0).cast("long").alias("b"))).distinct()


DEGREES_SQL = f"""{HUB_SQL}, d AS (SELECT p_partkey AS id, (SELECT count(*) FROM g WHERE a = p_partkey AND a <> b) AS fan_out, (SELECT count(*) FROM g WHERE b = p_partkey AND a <> b) AS fan_in
  FROM part)"""


def part_degrees(t: Tables) -> DataFrame:
    return G.degrees(t.part.select(F.col("p_partkey").alias("id")), hub_graph(t))


@query("a27_degrees", f"WITH {DEGREES_SQL} SELECT * FROM d")
def a27(t: Tables) -> DataFrame:
    return part_degrees(t)


@query("a28_concentration", f"WITH {DEGREES_SQL}, r AS (SELECT fan_in, row_number() OVER (ORDER BY fan_in DESC) AS rn, count(*) OVER () AS n FROM d) SELECT max(n) AS n_nodes, sum(fan_in) FILTER (rn <= greatest(1, n // 10))::BIGINT AS top_edges, sum(fan_in)::BIGINT AS all_edges FROM r")
def a28(t: Tables) -> DataFrame:
    return G.concentration(part_degrees(t), "fan_in", "id")


@query("l08_top_degrees", f"WITH {DEGREES_SQL} SELECT id, fan_in FROM d ORDER BY fan_in DESC, id LIMIT 5")
def l08(t: Tables) -> DataFrame:
    return G.top_degrees(part_degrees(t), "fan_in", "id").select("id", "fan_in")


REACH_SQL = f"""WITH RECURSIVE {HUB_SQL}, r(start, node) AS (SELECT DISTINCT a, a FROM g UNION SELECT r.start, g.b FROM r JOIN g ON g.a = r.node)"""


@query("g02_reach", f"{REACH_SQL} SELECT start, node FROM r WHERE start <> node")
def g02(t: Tables) -> DataFrame:
    g = hub_graph(t)
    return G.reach(g, g.select(F.col("a").alias("start")).distinct()).select("start", "node")


@query(
    "g02_pairs_reached",
    f"""{REACH_SQL}, asked AS (SELECT DISTINCT l_partkey AS a, (l_partkey + l_suppkey) % (SELECT count(*) FROM part) AS b FROM lineitem WHERE l_quantity > 25 UNION SELECT p_partkey, p_partkey // 2 FROM part)
SELECT DISTINCT asked.a, asked.b FROM asked JOIN r ON r.start = asked.a AND r.node = asked.b WHERE asked.a <> asked.b""",
)
def g02_pairs(t: Tables) -> DataFrame:
    """Which of the pairs that lines name reach each other, by labels of all parts."""
    n = t.part.agg(F.count("*").alias("n"))  # one row
    asked = t.lineitem.where("l_quantity > 25").crossJoin(F.broadcast(n)).select(F.col("l_partkey").alias("a"), ((F.col("l_partkey") + F.col("l_suppkey")) % F.col("n")).alias("b"))
    asked = asked.unionByName(t.part.select(F.col("p_partkey").alias("a"), F.floor(F.col("p_partkey") / 2).alias("b")))
    return reachability.Index(hub_graph(t)).among(asked, "a", "b")


@query(
    "g01_participants",
    f"""WITH RECURSIVE {HUB_SQL}, s AS (SELECT p_partkey AS file, CASE WHEN p_size % 7 = 0 THEN 'schema' ELSE 'callable' END AS kind FROM part),
may AS (SELECT NULL::BIGINT AS entry, file FROM s WHERE kind <> 'schema' AND file % 4 IN (1, 2) UNION ALL SELECT a, b FROM g JOIN s ON s.file = b WHERE kind <> 'schema' AND b % 4 = 3),
core(entry, file) AS (SELECT DISTINCT a, a FROM g UNION SELECT core.entry, g.b FROM core JOIN g ON g.a = core.file JOIN may ON may.file = g.b AND coalesce(may.entry, core.entry) = core.entry),
hop AS (SELECT DISTINCT core.entry, g.b AS target FROM core JOIN g ON g.a = core.file)
SELECT entry, 'core' AS tier, 'f' || file AS target FROM core
UNION ALL SELECT hop.entry, CASE kind WHEN 'schema' THEN 'data' ELSE 'dependencies' END, 's' || target FROM hop JOIN s ON s.file = hop.target
WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.entry = hop.entry AND c.file = hop.target)""",
)
def g01(t: Tables) -> DataFrame:
    """Files admitted to every core, and files admitted only where the entry itself leads to them."""
    g = checkpointed(hub_graph(t))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    entries = g.select(F.col("a").alias("entry"), name("f", "a").alias("file")).distinct()
    edges = g.select(name("f", "a").alias("from_file"), name("f", "b").alias("target_file"), name("s", "b").alias("target"))
    kind = F.when(F.col("p_size") % 7 == 0, "schema").otherwise("callable")
    symbols = t.part.select(name("s", "p_partkey").alias("id"), name("f", "p_partkey").alias("file"), kind.alias("kind"))
    everywhere = t.part.where("p_partkey % 4 IN (1, 2)").select(F.lit(None).cast("long").alias("entry"), name("f", "p_partkey").alias("file"))
    return G.participants(entries, edges, everywhere.unionByName(g.where("b % 4 = 3").select(F.col("a").alias("entry"), name("f", "b").alias("file"))), symbols)


@query("g08_components", f"WITH RECURSIVE {HUB_SQL}, u AS (SELECT a, b FROM g UNION SELECT b, a FROM g), r(start, node) AS (SELECT a, a FROM u UNION SELECT r.start, u.b FROM r JOIN u ON u.a = r.node) SELECT start AS node, min(node) AS component FROM r GROUP BY start")
def g08(t: Tables) -> DataFrame:
    return G.components(hub_graph(t))


@query(
    "g07_strong_components",
    f"WITH RECURSIVE {HUB_SQL}, r(start, node) AS (SELECT a, b FROM g UNION SELECT r.start, g.b FROM r JOIN g ON g.a = r.node) SELECT x.start AS node, least(min(x.node), x.start) AS component FROM r x JOIN r y ON x.start = y.node AND x.node = y.start WHERE x.start <> x.node GROUP BY x.start",
)
def g07(t: Tables) -> DataFrame:
    return G.strong_components(hub_graph(t))


@query("p03_owner_lookup", "SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey IN (3, 77, 1200)")
def p03(t: Tables) -> DataFrame:
    """A node and its owners, by key."""
    owners = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return P.owned(t.customer, F.broadcast(owners), [3, 77, 1200], "c_custkey", "c_nationkey", "n_nationkey").select("c_custkey", "c_name", "n_name", "r_name")  # 25 owners


@query("t04_intersect", "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def t04(t: Tables) -> DataFrame:
    lines = t.lineitem
    return lines.where("l_returnflag = 'R'").select("l_partkey").intersect(lines.where("l_returnflag = 'N'").select("l_partkey"))


@query("t01_union_targets", "SELECT l_orderkey AS file, l_partkey AS target FROM lineitem UNION SELECT o_orderkey, o_custkey FROM orders")
def t01(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("target")).unionByName(t.orders.select(F.col("o_orderkey").alias("file"), F.col("o_custkey").alias("target"))).distinct()
