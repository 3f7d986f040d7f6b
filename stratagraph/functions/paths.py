"""Path and id functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that each pack reads, and path parts that decide a file's role.
CPP_HEADERS = ["h", "hpp", "hh", "hxx", "ipp", "inl", "tpp", "tcc", "cppm", "ixx"]
CPP_SOURCES = ["cc", "cpp", "cxx"]
COMPONENT_TESTS = ["e2e/", "cypress/", "playwright/"]
GENERATED_JAVA = ["target/generated-sources/", "build/generated/"]
VENDORED = ["third_party", "3rdparty", "thirdparty"]
VENDORED_AT_ROOT = ["vendor", "external", "extern", "deps"]
CPP_TEST_DIRS = ["test", "tests", "unittests", "testing", "benchmarks", "mocks"]
CPP_TEST_ENDS = ["_test", "_tests", "_unittest", "_benchmark", "-test"]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory(path: Column) -> Column:
    """The path without its last part; the root is ``.``."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def file_of(symbol_id: Column) -> Column:
    return F.substring_index(symbol_id, "::", 1)


def short_name(symbol_id: Column) -> Column:
    return F.regexp_extract(symbol_id, r"([^:.]*)$", 1)


def within_scope(path: Column, scope: str) -> Column:
    """An empty scope holds all; else the path itself or what lies below it."""
    return F.lit(True) if not scope else (path == scope) | path.startswith(scope + "/")


def source_kind(path: Column) -> Column:
    """(pack, kind) of a path, null where no pack reads it."""
    ext = extension(path)
    kind = lambda pack, what="code": F.struct(F.lit(pack).alias("pack"), F.lit(what).alias("kind"))
    return (
        F.when(ext.isin("ts", "tsx") & ~F.lower(path).endswith(".d.ts"), kind("typescript"))
        .when(ext == "sql", kind("typescript", "schema"))
        .when(ext == "rs", kind("rust"))
        .when(ext == "java", kind("java"))
        .when(ext == "py", kind("python"))
        .when(ext.isin(*CPP_HEADERS, *CPP_SOURCES), kind("cpp"))
    )


def _any(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def role(path: Column, pack: Column) -> Column:
    """domain, primitive, test or generated, by the pack's rules."""
    name, folder = file_name(path), F.when(F.instr(path, "/") > 0, directory(path)).otherwise(F.lit(""))
    plain = F.regexp_replace(path, "^(rollup|feature):", "")
    stem, parts = F.substring_index(name, ".", 1), F.split(folder, "/")
    starts, has = (lambda x: path.startswith(x)), (lambda x: path.contains(x))
    component_test = _any(*[plain.startswith(t) | plain.contains("/" + t) for t in COMPONENT_TESTS], *[plain.contains(t) for t in ("__tests__/", ".test.", ".spec.")])
    vendored = F.arrays_overlap(parts, F.array(*map(F.lit, VENDORED))) | F.get(parts, F.lit(0)).isin(*VENDORED_AT_ROOT) | name.contains(".pb.")
    cpp_test = F.arrays_overlap(parts, F.array(*map(F.lit, CPP_TEST_DIRS))) | _any(*[stem.endswith(e) for e in CPP_TEST_ENDS], stem.startswith("test_"), stem.startswith("mock_"))
    python_test = _any(has("/tests/"), starts("tests/"), name == "conftest.py", name.startswith("test_"), name.endswith("_test.py"))
    by_pack = {
        "typescript": F.when(component_test, "test").when(plain.startswith("components/ui/") | plain.contains("/components/ui/"), "primitive"),
        "rust": F.when(_any(starts("tests/"), starts("benches/"), has("/tests/")), "test"),
        "java": F.when(_any(has("src/test/"), has("/test/java/")), "test").when(_any(*[has(g) for g in GENERATED_JAVA]), "generated"),
        "python": F.when(python_test, "test").when(_any(has("/alembic/versions/"), has("/migrations/versions/")), "generated"),
        "cpp": F.when(vendored, "generated").when(cpp_test, "test"),
    }
    out = F.lit("domain")
    for one, rule in by_pack.items():
        out = F.when(pack == one, rule.otherwise("domain")).otherwise(out)
    return out


def slug(path: Column) -> Column:
    """A page or route file's slug: ``app/`` and the file name go, slashes become dashes, nothing is ``home``."""
    cut = F.regexp_replace(F.regexp_replace(path, "^app/", ""), "/?(page\\.tsx|route\\.ts)$", "")
    return F.when(cut == "", F.lit("home")).otherwise(F.replace(cut, F.lit("/"), F.lit("-")))


def join_route(prefix: Column, path: Column) -> Column:
    """One slash between a prefix and a path, one at the start, none at the end (but the root's)."""
    both = F.concat_ws("/", F.filter(F.array(F.regexp_replace(prefix, "^/+|/+$", ""), F.regexp_replace(path, "^/+|/+$", "")), lambda x: x != ""))
    return F.concat(F.lit("/"), both)


def relative_link(from_path: Column, to_path: Column, anchor: Column | None = None) -> Column:
    """The link from one document to another, with a section's anchor where one is given."""
    a, b = F.split(directory(F.concat(F.lit("/"), from_path)), "/"), F.split(directory(F.concat(F.lit("/"), to_path)), "/")
    n = F.least(F.size(a), F.size(b))
    same = F.aggregate(
        F.sequence(F.lit(1), n),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, i: F.struct((acc.n + F.when(acc.on & (F.element_at(a, i) == F.element_at(b, i)), 1).otherwise(0)).alias("n"), (acc.on & (F.element_at(a, i) == F.element_at(b, i))).alias("on")),
    ).n
    down = F.when(same < F.size(b), F.slice(b, (same + 1).cast("int"), F.size(b))).otherwise(F.array().cast("array<string>"))
    path = F.concat(F.repeat(F.lit("../"), (F.size(a) - same).cast("int")), F.array_join(F.concat(down, F.array(file_name(to_path))), "/"))
    return path if anchor is None else F.concat_ws("#", path, anchor)
