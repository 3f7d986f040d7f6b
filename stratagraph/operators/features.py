"""Entry points of a repository, by framework: pages and routes, decorated callables, annotated classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions.paths import file_name, join_route, role, slug

# Verbs and annotations that make an entry point.
ROUTE_VERBS = ["get", "post", "put", "patch", "delete", "head", "options", "websocket"]
HTTP_ANNOTATIONS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def kind_slug(*parts: Column) -> Column:
    words = F.regexp_replace(F.regexp_replace(F.concat_ws("-", *parts), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    return F.lower(words)


def numbered(entries: DataFrame) -> DataFrame:
    """Equal ids get ``-2``, ``-3`` and so on, in order of file and place."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("file", "ord"))
    return entries.withColumn("n", n).withColumn("id", F.when(F.col("n") > 1, F.concat_ws("-", "id", F.col("n").cast("string"))).otherwise(F.col("id"))).select("kind", "id", "title", "file")


def next_pages(files: DataFrame, flows: DataFrame) -> DataFrame:
    """Pages, and API routes that no file of the repository fetches."""
    fetched = flows.where("kind = 'route-literal' AND target_file IS NOT NULL").select(F.col("target_file").alias("file")).distinct()
    pages = files.where("file LIKE 'app/%' AND (file LIKE '%/page.tsx' OR file = 'app/page.tsx')").select("file", F.lit("page").alias("kind"))
    routes = files.where("file LIKE 'app/api/%/route.ts'").select("file").join(fetched, "file", "left_anti").select("file", F.lit("api").alias("kind"))
    return numbered(pages.unionByName(routes).select("kind", slug(F.col("file")).alias("id"), F.col("file").alias("title"), "file", F.lit(0).alias("ord")))


def fastapi_routes(symbols: DataFrame) -> DataFrame:
    """Callables with a route decorator; the file's APIRouter gives the prefix."""
    pattern = rf"""^[\w.]+\.({"|".join(ROUTE_VERBS)})\(\s*['"]([^'"]*)['"]"""
    routed = symbols.where("kind = 'callable'").select("file", "ord", "id", F.explode("markers").alias("m")).where(F.col("m").rlike(pattern))
    prefix = symbols.where("kind = 'value'").select("file", "ord", F.regexp_extract("signature", r"""APIRouter\(.*?prefix\s*=\s*['"]([^'"]*)['"]""", 1).alias("prefix")).where("prefix <> ''")
    prefix = prefix.groupBy("file").agg(F.min_by("prefix", "ord").alias("prefix"))
    verb, path = F.regexp_extract("m", pattern, 1), F.regexp_extract("m", pattern, 2)
    rows = routed.join(prefix, "file", "left").select("file", "ord", verb.alias("verb"), join_route(F.coalesce("prefix", F.lit("")), path).alias("route"))
    kind = F.when(F.col("verb") == "websocket", "websocket").otherwise("http")
    return numbered(rows.select(kind.alias("kind"), kind_slug(kind, F.col("verb"), F.col("route")).alias("id"), F.concat_ws(" ", F.upper("verb"), "route").alias("title"), "file", "ord"))


def quarkus_entries(symbols: DataFrame) -> DataFrame:
    """Methods with an HTTP, channel, schedule or gRPC annotation; REST clients and generated files are none."""
    has = lambda c, p: F.exists(c, lambda m: m.rlike(p))
    in_role = role(F.col("file"), F.lit("java"))
    own = symbols.where(in_role != "generated")
    types = own.where("kind = 'container'").select(F.col("id").alias("owner"), F.col("markers").alias("type_markers"), F.col("signature").alias("type_signature"))
    rows = own.where("kind = 'callable'").withColumnRenamed("parent", "owner").join(types, "owner").where(~has("type_markers", "^@RegisterRestClient"))
    rows = rows.withColumn("name", F.regexp_extract("id", "([^:]*)$", 1))
    # A class that implements a generated interface inherits the verb and paths of the method of that name.
    made = symbols.where(in_role == "generated")
    faces = made.where("raw = 'interface'").select(F.col("id").alias("parent"), F.regexp_extract("id", "([^:]*)$", 1).alias("face"), F.col("markers").alias("face_markers"))
    methods = made.where("kind = 'callable'").select("parent", F.regexp_extract("id", "([^:]*)$", 1).alias("name"), F.col("markers").alias("own_markers")).join(faces, "parent")
    names = types.select("owner", F.posexplode(F.regexp_extract_all(F.regexp_extract("type_signature", r"\bimplements\s+(.*)$", 1), F.lit(r"(\w+)"), F.lit(1))).alias("pos", "face"))
    inherited = names.join(methods, "face").groupBy("owner", "name").agg(F.min_by(F.struct("own_markers", "face_markers"), "pos").alias("up"))
    rows = rows.join(inherited, ["owner", "name"], "left")
    bare = ~has("markers", f"^@({'|'.join(HTTP_ANNOTATIONS)})\\b") & F.col("up").isNotNull()
    rows = rows.withColumn("type_markers", F.when(bare, F.concat("type_markers", "up.face_markers")).otherwise(F.col("type_markers"))).withColumn("markers", F.when(bare, F.concat("markers", "up.own_markers")).otherwise(F.col("markers")))
    # A channel may be named by a constant of the class: its literal is in the member's signature.
    values = own.where("kind = 'value'").select(F.col("parent").alias("owner"), F.regexp_extract("id", "([^:]*)$", 1).alias("constant"), F.regexp_extract("signature", '"([^"]*)"', 1).alias("literal"), "ord")
    values = values.groupBy("owner", "constant").agg(F.min_by("literal", "ord").alias("literal"))
    constant = F.regexp_extract(F.coalesce(F.get(F.filter("markers", lambda m: m.rlike("^@Incoming")), F.lit(0)), F.lit("")), r"^@Incoming\(\s*(?:\w+\.)*(\w+)\s*\)", 1)
    rows = rows.withColumn("constant", constant).join(values, ["owner", "constant"], "left")
    first = lambda c, p: F.regexp_extract(F.coalesce(F.get(F.filter(c, lambda m: m.rlike(p)), F.lit(0)), F.lit("")), r'"([^"]*)"', 1)
    verbs = F.filter(F.transform("markers", lambda m: F.regexp_extract(m, f"^@({'|'.join(HTTP_ANNOTATIONS)})\\b", 1)), lambda v: v != "")
    http, incoming = F.size(verbs) > 0, has("markers", "^@Incoming")
    grpc = has("type_markers", "^@GrpcService") & F.col("public")
    kind = F.when(http, "http").when(incoming, "kafka").when(has("markers", "^@Scheduled"), "scheduled").when(grpc, "grpc")
    route = join_route(first("type_markers", "^@Path"), first("markers", "^@Path"))
    title = F.when(http, F.concat_ws(" ", F.get(verbs, F.lit(0)), route)).when(incoming, F.coalesce("literal", first("markers", "^@Incoming"))).otherwise(F.col("name"))
    rows = rows.withColumn("entry", kind).where("entry IS NOT NULL")
    return numbered(rows.select(F.col("entry").alias("kind"), kind_slug(F.col("entry"), title).alias("id"), title.alias("title"), "file", "ord"))


def entry_points(pack: str, files: DataFrame, symbols: DataFrame, flows: DataFrame) -> DataFrame:
    if pack == "typescript":
        return next_pages(files, flows)
    if pack == "python":
        return fastapi_routes(symbols)
    if pack == "java":
        return quarkus_entries(symbols)
    return files.sparkSession.createDataFrame([], "kind string, id string, title string, file string")


def admitted(pack: str, entries: DataFrame, files: DataFrame, symbols: DataFrame, flows: DataFrame, imports: DataFrame) -> DataFrame:
    """(entry, file): files that may join an entry's core; a null entry admits a file to every entry."""
    anywhere = lambda df: df.select(F.lit(None).cast("string").alias("entry"), "file").distinct()
    pairs = entries.select(F.col("id").alias("entry"), F.col("file").alias("start"))
    if pack == "typescript":
        work = flows.where("kind IN ('route-literal', 'table-ref')").select(F.col("from_file").alias("file")).unionByName(files.where("file LIKE 'app/api/%/route.ts'").select("file")).distinct()
        near = pairs.withColumn("dir", F.regexp_extract("start", "^(.*)/[^/]*$", 1)).where("dir <> ''")
        dirs = files.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/"))), lambda i: F.array_join(F.slice(F.split("file", "/"), 1, i), "/"))).alias("dir"))
        return anywhere(work).unionByName(near.join(dirs, "dir").select("entry", "file")).distinct()
    if pack == "python":
        schema = symbols.where("kind = 'schema'").select("id", "file")
        touch = imports.join(schema.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("from_file").alias("file"))
        crud = files.where((file_name(F.col("file")) == "crud.py") | F.col("file").rlike("(^|/)(crud|repositories|repository)/|repository\\.py$")).select("file")
        ok = touch.unionByName(crud).unionByName(schema.select("file")).distinct()
    else:
        beans = symbols.where("kind = 'container'").where(F.exists("markers", lambda m: m.rlike("^@(ApplicationScoped|Singleton)\\b")) | F.col("signature").contains("PanacheRepository"))
        ok = beans.select("file").distinct()
    return anywhere(ok)
