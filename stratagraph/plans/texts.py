"""Text family over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import paths as P
from stratagraph.functions import text as X
from stratagraph.operators import reports as R
from stratagraph.operators import search as S
from stratagraph.plans.registry import Tables, query

# Fixed values of the bindings: a path per document whose extension follows from its id.
EXTENSIONS = ["ts", "d.ts", "sql", "rs", "py", "java", "cpp", "c", "md", "tsx", "HPP"]
FOLDERS = ["src", "tests", "components/ui", "app/__tests__", "third_party/x", "target/generated-sources", "src/test/java"]
EXT_SQL = "list_extract(['" + "','".join(EXTENSIONS) + "'], (doc_id % 11 + 1)::INT)"
FOLDER_SQL = "list_extract(['" + "','".join(FOLDERS) + "'], (doc_id % 7 + 1)::INT)"
PATHS_SQL = f"paths AS (SELECT doc_id, {FOLDER_SQL} || '/' || source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'test_' ELSE '' END || doc_id || '.' || {EXT_SQL} AS path, n_chars FROM documents)"


def paths(t: Tables) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    name = F.concat(F.when(F.col("doc_id") % 5 == 0, "test_").otherwise(""), F.col("doc_id").cast("string"), F.lit("."), pick(EXTENSIONS, 11))
    return t.documents.select("doc_id", F.concat_ws("/", pick(FOLDERS, 7), "source", name).alias("path"), "n_chars")


KIND_SQL = """CASE WHEN ext IN ('ts','tsx') AND NOT ends_with(lower(path), '.d.ts') THEN 'typescript' WHEN ext = 'sql' THEN 'typescript' WHEN ext = 'rs' THEN 'rust'
  WHEN ext = 'java' THEN 'java' WHEN ext = 'py' THEN 'python' WHEN ext IN ('cpp', 'hpp') THEN 'cpp' END"""
ROUTED_SQL = f"""{PATHS_SQL}, e AS (SELECT *, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext FROM paths), routed AS (SELECT *, {KIND_SQL} AS pack FROM e)"""


@query("s05_source_kind_route", f"WITH {ROUTED_SQL} SELECT path, pack, CASE WHEN ext = 'sql' THEN 'schema' ELSE 'code' END AS kind FROM routed WHERE pack IS NOT NULL")
def s05(t: Tables) -> DataFrame:
    kind = P.source_kind(F.col("path"))
    return paths(t).withColumn("k", kind).where("k IS NOT NULL").select("path", "k.pack", "k.kind")


@query("s04_stack_detection", f"WITH {ROUTED_SQL} SELECT pack, count(*) AS files FROM routed WHERE pack IS NOT NULL AND ext <> 'sql' GROUP BY pack")
def s04(t: Tables) -> DataFrame:
    return paths(t).withColumn("k", P.source_kind(F.col("path"))).where("k.kind = 'code'").groupBy("k.pack").agg(F.count("*").alias("files"))


@query(
    "p05_role_classify",
    f"""WITH {ROUTED_SQL} SELECT path, CASE pack
  WHEN 'typescript' THEN CASE WHEN contains(path, '__tests__/') THEN 'test' WHEN starts_with(path, 'components/ui/') THEN 'primitive' ELSE 'domain' END
  WHEN 'rust' THEN CASE WHEN starts_with(path, 'tests/') THEN 'test' ELSE 'domain' END
  WHEN 'java' THEN CASE WHEN contains(path, 'src/test/') THEN 'test' WHEN contains(path, 'target/generated-sources/') THEN 'generated' ELSE 'domain' END
  WHEN 'python' THEN CASE WHEN starts_with(path, 'tests/') OR contains(path, '/test_') THEN 'test' ELSE 'domain' END
  WHEN 'cpp' THEN CASE WHEN starts_with(path, 'third_party/') THEN 'generated' WHEN starts_with(path, 'tests/') OR starts_with(path, 'src/test/') OR contains(path, '/test_') THEN 'test' ELSE 'domain' END
  END AS role FROM routed WHERE pack IS NOT NULL""",
)
def p05(t: Tables) -> DataFrame:
    own = paths(t).withColumn("pack", P.source_kind(F.col("path")).pack).where("pack IS NOT NULL")
    return own.select("path", P.role(F.col("path"), F.col("pack")).alias("role"))


DIRS_SQL = f"""{ROUTED_SQL}, dirs AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS files FROM routed WHERE pack IS NOT NULL AND n_chars >= 1000 GROUP BY 1)"""


@query("p09_spec_bearing_dirs", f"WITH {DIRS_SQL} SELECT dir, files FROM dirs WHERE files >= 2")
def p09(t: Tables) -> DataFrame:
    own = paths(t).where(P.source_kind(F.col("path")).isNotNull() & (F.col("n_chars") >= 1000))
    return own.groupBy(P.directory(F.col("path")).alias("dir")).agg(F.count("*").alias("files")).where("files >= 2")


@query("p10_modules", f"WITH {DIRS_SQL} SELECT dir FROM dirs WHERE files >= 2 AND NOT regexp_matches(dir || '/', '(^|/)tests/')")
def p10(t: Tables) -> DataFrame:
    return p09(t).where(~F.concat("dir", F.lit("/")).rlike("(^|/)tests/")).select("dir")


@query("p11_scope_filter", f"WITH {PATHS_SQL} SELECT path FROM paths WHERE path = 'src/src1' OR starts_with(path, 'src/src1/')")
def p11(t: Tables) -> DataFrame:
    own = paths(t)
    return own.where(P.within_scope(F.col("path"), "src/src1")).select("path")


NAMES = ["the", "und", "de", "License", "x$y"]


@query(
    "p12_whole_word",
    "WITH n(name) AS (VALUES ('the'), ('und'), ('de'), ('License'), ('x$y')) SELECT doc_id, name FROM documents CROSS JOIN n WHERE regexp_matches(text, '(^|[^A-Za-z0-9_$])' || replace(name, '$', '[$]') || '([^A-Za-z0-9_$]|$)')",
)
def p12(t: Tables) -> DataFrame:
    """Texts are cut into words once; an equi join replaces a regular expression per pair."""
    names = t.spark.range(1).select(F.explode(F.array(*map(F.lit, NAMES))).alias("name"))
    return t.documents.select("doc_id", F.explode(X.words(F.col("text"))).alias("name")).join(F.broadcast(names), "name").select("doc_id", "name")


LINES_SQL = """CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN list_slice(string_split(text, chr(10)), 1, len(string_split(text, chr(10))) - 1) ELSE string_split(text, chr(10)) END"""


@query(
    "p02_line_span_source",
    f"""WITH l AS (SELECT doc_id, {LINES_SQL} AS ls, doc_id % 5 + 1 AS s, doc_id % 5 + 1 + doc_id % 3 AS e FROM documents)
SELECT doc_id, CASE WHEN least(e + 1, len(ls)) < greatest(s - 1, 1) THEN '' ELSE array_to_string(list_slice(ls, greatest(s - 1, 1), least(e + 1, len(ls))), chr(10)) END AS source FROM l""",
)
def p02(t: Tables) -> DataFrame:
    start = F.col("doc_id") % 5 + 1
    return t.documents.select("doc_id", X.span(F.col("text"), start, start + F.col("doc_id") % 3, context=1).alias("source"))


@query(
    "s18_ddl_backstop_lines",
    """WITH l AS (SELECT p_partkey, 'CREATE TABLE IF NOT EXISTS public.' || replace(p_name, ' ', '_') || ' (id INT);' || chr(10) || 'alter table x;' || chr(10) || 'create table "T' || p_partkey || '" (' AS text FROM part),
m AS (SELECT p_partkey, unnest(string_split(text, chr(10))) AS line FROM l)
SELECT p_partkey, regexp_extract(line, '(?i)^\\s*create\\s+table\\s+(if\\s+not\\s+exists\\s+)?("?[a-z_][a-z0-9_]*"?\\.)?"?([a-z_][a-z0-9_]*)', 3) AS tbl FROM m WHERE regexp_matches(line, '(?i)^\\s*create\\s+table')""",
)
def s18(t: Tables) -> DataFrame:
    from stratagraph.extract.sql_pack import HEADER

    text = F.concat(F.lit("CREATE TABLE IF NOT EXISTS public."), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" (id INT);\nalter table x;\ncreate table \"T"), F.col("p_partkey").cast("string"), F.lit('" ('))
    own = t.part.select("p_partkey", F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(HEADER))
    return own.select("p_partkey", F.regexp_extract("line", HEADER, 3).alias("tbl"))


@query("f01_stable_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def f01(t: Tables) -> DataFrame:
    from stratagraph.functions.hashing import stable

    return t.documents.select("doc_id", stable(F.col("text")).alias("hash"))


@query(
    "f02_byte_cap",
    """WITH c AS (SELECT doc_id, text, strlen(text) > 500 AS truncated, [n for n in [500, 499, 498, 497] if strlen(left(text, length(text))) >= n] AS ns FROM documents),
p AS (SELECT doc_id, text, truncated, list_max([k for k in range(least(length(text), 125), least(length(text), 500) + 1) if strlen(left(text, k)) <= 500]) AS k FROM c)
SELECT doc_id, CASE WHEN truncated THEN left(text, k) ELSE text END AS text, truncated FROM p""",
)
def f02(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.cap_bytes(F.col("text"), 500).alias("c")).select("doc_id", "c.text", "c.truncated")


@query(
    "f07_slug",
    """WITH p AS (SELECT doc_id, list_extract(['app/page.tsx', 'app/' || source || '/page.tsx', 'app/api/' || lang || '/' || source || '/route.ts', source || '/x.py'], (doc_id % 4 + 1)::INT) AS path FROM documents),
c AS (SELECT doc_id, regexp_replace(regexp_replace(path, '^app/', ''), '/?(page\\.tsx|route\\.ts)$', '') AS cut FROM p)
SELECT doc_id, CASE WHEN cut = '' THEN 'home' ELSE replace(cut, '/', '-') END AS slug FROM c""",
)
def f07(t: Tables) -> DataFrame:
    path = F.element_at(
        F.array(F.lit("app/page.tsx"), F.concat(F.lit("app/"), "source", F.lit("/page.tsx")), F.concat(F.lit("app/api/"), "lang", F.lit("/"), "source", F.lit("/route.ts")), F.concat("source", F.lit("/x.py"))),
        (F.col("doc_id") % 4 + 1).cast("int"),
    )
    return t.documents.select("doc_id", P.slug(path).alias("slug"))


@query(
    "f08_route_join",
    """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '/' || source || '/' END AS a, CASE WHEN doc_id % 4 = 0 THEN '/' ELSE lang || '/x/' END AS b FROM documents)
SELECT doc_id, '/' || array_to_string(list_filter([trim(a, '/'), trim(b, '/')], lambda x: x <> ''), '/') AS route FROM p""",
)
def f08(t: Tables) -> DataFrame:
    a = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("/"), "source", F.lit("/")))
    b = F.when(F.col("doc_id") % 4 == 0, "/").otherwise(F.concat("lang", F.lit("/x/")))
    return t.documents.select("doc_id", P.join_route(a, b).alias("route"))


@query("f09_kind_slug", "SELECT p_partkey, 'http-' || lower(trim(regexp_replace(p_name || ' /{' || p_brand || '} ', '[^A-Za-z0-9]+', '-', 'g'), '-')) AS slug FROM part")
def f09(t: Tables) -> DataFrame:
    from stratagraph.operators.features import kind_slug

    return t.part.select("p_partkey", kind_slug(F.lit("http"), F.concat("p_name", F.lit(" /{"), "p_brand", F.lit("} "))).alias("slug"))


SMELL_SQL = """list_filter([
  CASE WHEN contains(lower(t), 'see the source') OR contains(lower(t), 'check the source') THEN 'cop_out_phrase' END,
  CASE WHEN contains(t, '</content>') THEN 'stray_markup' END,
  CASE WHEN len(list_filter(regexp_split_to_array(t, '\\s+'), lambda w: w <> '')) < 4 THEN 'suspiciously_short' END], lambda s: s IS NOT NULL)"""
SMELLY_SQL = "CASE WHEN doc_id % 6 = 0 THEN 'See the source. ' || text WHEN doc_id % 7 = 0 THEN text || '</content>' WHEN doc_id % 8 = 0 THEN left(text, 9) ELSE text END"


def smelly(t: Tables) -> DataFrame:
    text = F.col("text")
    made = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("See the source. "), text)).when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("</content>"))).when(F.col("doc_id") % 8 == 0, F.substring(text, 1, 9)).otherwise(text)
    return t.documents.select("doc_id", "source", made.alias("t"))


@query("f12_prose_smells", f"WITH x AS (SELECT doc_id, {SMELLY_SQL} AS t FROM documents) SELECT doc_id, array_to_string({SMELL_SQL}, ',') AS smells FROM x")
def f12(t: Tables) -> DataFrame:
    return smelly(t).select("doc_id", F.array_join(X.smells(F.col("t")), ",").alias("smells"))


@query("a22_smell_union", f"WITH x AS (SELECT source, {SMELLY_SQL} AS t FROM documents), s AS (SELECT source, unnest({SMELL_SQL}) AS smell FROM x) SELECT source, string_agg(DISTINCT smell, ',' ORDER BY smell) AS smells FROM s GROUP BY source")
def a22(t: Tables) -> DataFrame:
    s = smelly(t).select("source", F.explode(X.smells(F.col("t"))).alias("smell"))
    return s.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("smell")), ",").alias("smells"))


@query("f13_code_span")
def f13(t: Tables) -> DataFrame:
    """Rows only in the driver's check: backtick runs need a loop; tests hold it against a plain reading."""
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("`a` ``b` "), F.col("text"))).otherwise(F.concat(F.lit("`ok` "), F.col("text")))
    return t.documents.select("doc_id", X.open_code_span(made).alias("open"))


@query("w05_text_pages")
def w05(t: Tables) -> DataFrame:
    """Rows only in the driver's check: pages restart at each cut; tests hold that they join to the text."""
    return t.documents.select("doc_id", F.posexplode(X.pages(F.col("text"), 4000)).alias("page", "text"))


@query(
    "f14_section",
    """WITH m AS (SELECT doc_id, '# Top' || chr(10) || '## Summary' || chr(10) || lang || ' text' || chr(10) || source || chr(10) || '## Next' || chr(10) || 'rest' AS md FROM documents WHERE doc_id % 2 = 0
  UNION ALL SELECT doc_id, '# Top' || chr(10) || 'Summary' FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, CASE WHEN contains(md, '## Summary' || chr(10)) THEN trim(split_part(split_part(md, '## Summary' || chr(10), 2), chr(10) || '## ', 1)) END AS summary FROM m""",
)
def f14(t: Tables) -> DataFrame:
    full = F.concat(F.lit("# Top\n## Summary\n"), "lang", F.lit(" text\n"), "source", F.lit("\n## Next\nrest"))
    md = F.when(F.col("doc_id") % 2 == 0, full).otherwise(F.lit("# Top\nSummary"))
    return t.documents.select("doc_id", X.section(md, "Summary").alias("summary"))


@query("f17_id_parts", "SELECT doc_id, source || '/' || lang AS file, doc_id::VARCHAR AS short FROM documents")
def f17(t: Tables) -> DataFrame:
    symbol = F.concat_ws("::", F.concat_ws("/", "source", "lang"), F.lit("Outer"), F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", P.file_of(symbol).alias("file"), P.short_name(symbol).alias("short"))


@query("f19_change_split", "SELECT p_partkey, split_part(p_type || ':' || p_brand || ':x', ':', 1) AS action, substr(p_type || ':' || p_brand || ':x', strpos(p_type || ':' || p_brand || ':x', ':') + 1) AS target FROM part")
def f19(t: Tables) -> DataFrame:
    action, target = R.change_parts(F.concat_ws(":", "p_type", "p_brand", F.lit("x")))
    return t.part.select("p_partkey", action.alias("action"), target.alias("target"))


@query(
    "x01_search",
    f"""WITH l AS (SELECT doc_id, {LINES_SQL} AS ls FROM documents), p AS (SELECT doc_id AS file, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM l),
m AS (SELECT file, line_no, line FROM p WHERE regexp_matches(line, '(?i)licen[cs]e') ORDER BY file, line_no LIMIT 200),
c AS (SELECT *, coalesce(sum(strlen(line)) OVER (ORDER BY file, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM m)
SELECT file, line_no::INT AS line_no, line FROM c WHERE so_far < 100000 AND strlen(line) <= 500""",
)
def x01(t: Tables) -> DataFrame:
    found = S.search(t.documents.select(F.col("doc_id").alias("file"), "text"), "licen[cs]e", ignore_case=True, context=2)
    return found.where("NOT truncated").select("file", "line_no", "line")


@query(
    "w03_context_lines",
    """SELECT conv_id, turn, coalesce(array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS before,
  coalesce(array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS after FROM conversations""",
)
def w03(t: Tables) -> DataFrame:
    rows = S.context(t.conversations, "conv_id", "turn", "role", 2)
    return rows.select("conv_id", "turn", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query(
    "w04_merge_spans",
    """WITH s AS (SELECT DISTINCT l_orderkey AS k, l_linenumber * 10 + l_suppkey % 10 AS a, l_linenumber * 10 + l_suppkey % 10 + l_partkey % 12 AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM s),
i AS (SELECT *, sum(CASE WHEN last IS NULL OR a > last + 2 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b) AS island FROM m)
SELECT k, min(a) AS start, max(b) AS "end" FROM i GROUP BY k, island""",
)
def w04(t: Tables) -> DataFrame:
    a = F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10
    spans = t.lineitem.select(F.col("l_orderkey").alias("k"), a.alias("start"), (a + F.col("l_partkey") % 12).alias("end")).distinct()
    return S.merge_spans(spans, "k")


@query(
    "w06_byte_budget",
    """WITH c AS (SELECT conv_id, turn, coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM conversations)
SELECT conv_id, turn FROM c WHERE so_far < 600""",
)
def w06(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.octet_length("text").alias("size"))
    return S.byte_budget(rows, "conv_id", ["turn"], "size", 600).select("conv_id", "turn")


@query(
    "w01_slug_dedupe",
    """WITH r AS (SELECT doc_id, lang || '-' || source AS slug, row_number() OVER (PARTITION BY lang || '-' || source ORDER BY doc_id) AS n FROM documents)
SELECT doc_id, CASE WHEN n > 1 THEN slug || '-' || n ELSE slug END AS slug FROM r""",
)
def w01(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.concat_ws("-", "lang", "source").alias("slug"))
    return S.number_repeats(rows, "slug", ["doc_id"], "-").select("doc_id", "slug")


@query("w02_member_dedupe", "WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations) SELECT conv_id, turn, CASE WHEN n > 1 THEN conv_id || '::' || role || '#' || n ELSE conv_id || '::' || role END AS member FROM r")
def w02(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", F.concat_ws("::", F.col("conv_id").cast("string"), "role").alias("member"))
    return S.number_repeats(rows, "member", ["turn"], "#").select("conv_id", "turn", "member")


@query(
    "w08_heading_anchors",
    """WITH h AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(role || ' Part'), '[^a-z0-9 ]', '', 'g'), ' +', '-', 'g'), '-') AS a FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, a ORDER BY turn) AS n FROM h) SELECT conv_id, turn, CASE WHEN n > 1 THEN a || '-' || n - 1 ELSE a END AS anchor FROM r""",
)
def w08(t: Tables) -> DataFrame:
    return R.anchors(t.conversations, "conv_id", "turn", F.concat("role", F.lit(" Part"))).select("conv_id", "turn", "anchor")
