"""Files made of parts are read by many tasks, and once."""

import pytest
from stratagraph.extract import braces as B
from stratagraph.operators import linking
from stratagraph.plans import source_trees as P
from stratagraph.plans.registry import Tables
from stratagraph.sources import index as I
from stratagraph.sources import repo


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.01")


def test_a_table_of_one_row_group_is_spread(tables):
    assert tables.part.rdd.getNumPartitions() == 1
    assert P.tree(tables, "rust").rdd.getNumPartitions() == 2000 // P.TASK_PARTS[0]


def test_joined_relations_are_extracted_once(tables):
    rel = P.relations(tables, "python")
    assert all("MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (rel.files, rel.symbols, rel.imports))


@pytest.mark.parametrize(
    ("text", "options", "want"),
    [
        ('a = "x\\"y" // z\nb', {}, 'a = "    "     \nb'),
        ("/* a /* b */ c */ d", {"nested": True}, " " * 17 + " d"),
        ("/* a /* b */ c */ d", {}, " " * 12 + " c */ d"),
        ("""fn f<'a>(x: &'a str) { let c = '}'; r#"a"b"# }""", {"quotes": "\"'", "lifetimes": True}, """fn f<'a>(x: &'a str) { let c = ' '; r#"   "# }"""),
        ("'open\nx'y'", {}, "'    \nx' '"),
        ('"\\', {}, '" '),
    ],
)
def test_blank(text, options, want):
    assert B.blank(text, **options) == want


FLOW_FILES = [
    ("app/f/page.tsx", 'import Card from "../../c/card"\nimport { Btn } from "../../c/all"\nfetch("/api/y"); db.from("t"); const x = <Card><Btn /><Ext /></Card>\n'),
    ("c/card.tsx", "export default function Card() { return 1 }\nexport class K { go() { return 2 } }\n"),
    ("c/btn.tsx", "export const Btn = () => 1\n"),
    ("app/api/y/route.ts", "export async function GET() { return 1 }\n"),
    ("db/t.sql", "CREATE TABLE t (id int);\n"),
]


def _flows(spark, files, wanted=("names", "imports", "flows"), staged=True):
    index = I.extract(repo.routed(spark.createDataFrame(files, "file string, text string"), "typescript"), wanted=wanted)
    rel = I.Relations.staged(index) if staged else I.Relations.of(index)
    return rel, linking.resolve_flows(rel, linking.resolve_imports(rel, "typescript"))


@pytest.mark.parametrize("reexport", [False, True])
def test_links_by_what_was_seen_are_those_of_all_joins(spark, reexport):
    files = [*FLOW_FILES, ("c/all.ts", 'export { Btn } from "./btn"\n' if reexport else "export const Btn = 1\n")]
    rel, found = _flows(spark, files)
    assert (rel.chased, rel.suffixed, rel.injected) == (reexport, False, False)
    got = sorted((r.kind, r.raw, r.target) for r in found.collect())
    assert got == [
        ("component", "Btn", "c/btn.tsx::Btn" if reexport else "c/all.ts::Btn"), ("component", "Card", "c/card.tsx"), ("component", "Ext", None),
        ("route-literal", "/api/y", "app/api/y/route.ts"), ("table-ref", "t", "db/t.sql::t"),
    ]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, _flows(spark, files, ("symbols", "imports", "flows"), staged=False)[1].collect()))


def test_links_that_need_no_chase_are_resolved_by_few_joins(spark):
    _, found = _flows(spark, [*FLOW_FILES, ("c/all.ts", "export const Btn = 1\n")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 9
    assert "sequence" not in plan  # no path is cut into suffixes


def test_names_are_those_of_whole_symbols(spark):
    text = "export class K {\n  private a = 1\n  go() { return 2 }\n}\nexport { K as L }\nconst { p, q: [r] } = f(), s = (x) => x\nfunction K(): void\n"
    files = repo.routed(spark.createDataFrame([("a.ts", text), ("t.sql", FLOW_FILES[4][1])], "file string, text string"), "typescript")
    own = ["id", "file", "ord", "kind", "raw", "parent", "is_exported", "public", "is_top_level"]
    of = lambda wanted: sorted(tuple(r) for r in I.Relations.of(I.extract(files, wanted=(wanted,))).symbols.select(own).collect())
    assert len(of("names")) >= 7
    assert of("names") == of("symbols")
