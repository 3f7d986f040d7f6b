import pytest

from stratagraph.engine import Engine
from stratagraph.sources import documents as D
from stratagraph.sources import index as I
from stratagraph.sources import repo

FASTAPI = {
    "app/__init__.py": "from app.models import Item\n",
    "app/models.py": 'class Base:\n    pass\n\nclass Item(SQLModel, table=True):\n    id: int = 0\n\nclass Shape:\n    """A shape."""\n    side: int\n    _hidden: int\n    def area(self) -> int:\n        return 1\n',
    "app/deps.py": "def get_db():\n    return 1\n\ndef unrelated():\n    return 2\n",
    "app/crud.py": "from app.models import Item\n\ndef load():\n    return Item()\n",
    "app/routes.py": 'from app.deps import get_db\nfrom app import crud\nfrom app.models import Shape\nfrom fastapi import APIRouter, Depends\n\nrouter = APIRouter(prefix="/api")\n\n@router.get("/items")\ndef items(db=Depends(get_db)):\n    return crud.load(), Shape\n\n@router.get("/items/")\ndef items_again():\n    return 1\n',
    "tests/test_a.py": "from app.deps import get_db\n\ndef test_a():\n    pass\n",
    "ignored/x.py": "x = 1\n",
    ".gitignore": "ignored/\n",
    "_index.md": "get_db is here\n",
    "empty.py": "",
    "bad.py": "def (:\n",
}


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


@pytest.fixture(scope="module")
def fastapi(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    write(root, FASTAPI)
    (root / "binary.py").write_bytes(b"\xff\xfe")
    return root, Engine.build(spark, str(root))


def test_walk_and_index(spark, fastapi):
    root, e = fastapi
    paths = repo.walk(str(root))
    assert "ignored/x.py" not in paths and "_index.md" in paths and "empty.py" in paths
    files = {r.file: r for r in e.rel.files.collect()}
    assert e.pack == "python" and "binary.py" not in files and "empty.py" in files
    assert files["bad.py"].parse_errors == 1 and files["tests/test_a.py"].role == "test"


def test_links(fastapi):
    _, e = fastapi
    got = {(r.from_file, r.imported_name): r.target for r in e.imports.collect()}
    assert got["app/routes.py", "get_db"] == "app/deps.py::get_db"
    assert got["app/routes.py", "crud"] == "app/crud.py"
    assert got["app/routes.py", "APIRouter"] is None
    assert got["app/crud.py", "Item"] == "app/models.py::Item"
    assert {r.from_file for r in e.get_callers("app/deps.py::get_db").collect()} == {"app/routes.py", "tests/test_a.py"}
    assert [r.target for r in e.get_callees("app/crud.py::load").collect()] == ["app/models.py::Item"]
    assert {(r.kind, r.target) for r in e.flows.collect()} == {("depends", "app/deps.py::get_db")}


def test_lookup_and_search(fastapi):
    _, e = fastapi
    s = e.get_symbol("app/models.py::Shape").first()
    assert (s.kind, s.docstring, s.is_exported) == ("container", "A shape.", True)
    assert e.get_symbol("app/models.py::Item").first().kind == "schema"
    got = e.get_source("app/deps.py::get_db", 1).first()
    assert got.source == "def get_db():\n    return 1\n" and got.in_sync and not got.truncated
    hits = e.search_code("GET_DB", ignore_case=True, context_lines=1).collect()
    assert {r.file for r in hits} == {"_index.md", "app/deps.py", "app/routes.py", "tests/test_a.py"}
    assert {r.file for r in e.search_code("get_db", path="app").collect()} == {"app/deps.py", "app/routes.py"}


def test_entry_points_and_participants(fastapi):
    _, e = fastapi
    entries = sorted((r.id, r.title) for r in e.entry_points().collect())
    assert entries == [("http-get-api-items", "GET /api/items"), ("http-get-api-items-2", "GET /api/items")]
    own = {(r.tier, r.target) for r in e.participants().where("entry = 'http-get-api-items'").collect()}
    assert ("core", "app/routes.py") in own and ("core", "app/crud.py") in own
    assert ("data", "app/models.py::Item") in own and ("dependencies", "app/deps.py::get_db") in own
    assert ("dependencies", "app/models.py::Shape") in own


def test_lifecycle(spark, tmp_path):
    write(tmp_path, {"a/owner.py": "class Owner:\n    x: int\n    _y: int\n    def go(self, n):\n        return 1\n", "a/user.py": "from a.owner import Owner\n\ndef use():\n    return Owner()\n\ndef alone():\n    return 3\n"})
    e = Engine.build(spark, str(tmp_path))
    assert {r.status for r in e.coverage().collect()} == {"missing"}
    for id_ in ("a/owner.py::Owner", "a/owner.py", "a/user.py::use", "a/user.py::alone", "a/user.py"):
        assert e.next_task(id_.split("::")[0]) is not None
        e.submit(id_, f"What {id_} does here", "It does that")
    e.submit_rollup("a", "All of the folder a")
    assert {(r.id, r.status) for r in e.coverage().collect()} == {("a/owner.py", "current"), ("a/user.py", "current"), ("rollup:a", "current")}
    assert e.next_task("a/user.py") is None
    assert e.get_spec("a/user.py::use")["status"] == "current" and e.get_spec("rollup:a")["status"] == "current"
    assert e.get_spec("a/none.py")["status"] == "missing" and e.migrate_fingerprints() == 0
    report = {(r.level, r.name): r.freshness for r in e.coverage_report().collect()}
    assert report["all", ""] == 1.0

    def stale_after(old, new):
        path = tmp_path / "a/owner.py"
        before = path.read_text()
        path.write_text(before.replace(old, new))
        now = Engine.build(spark, str(tmp_path))
        out = {r.id for r in now.changes().collect()}
        causes = {(r.id, r.cause, r.target) for r in now.explain().collect()}
        path.write_text(before)
        return out, causes

    body, _ = stale_after("return 1", "return 2")
    assert body == {"a/owner.py", "a/owner.py::Owner"}
    private, _ = stale_after("_y: int", "_y: str")
    assert "a/user.py::use" not in private and "a/owner.py::Owner" in private
    public, causes = stale_after("def go(self, n)", "def go(self, n, m)")
    assert {"a/user.py", "a/user.py::use"} <= public and "a/user.py::alone" not in public
    assert ("a/user.py::use", "dependency", "changed:a/owner.py::Owner") in causes
    renamed, _ = stale_after("class Owner", "class Other")
    assert "a/owner.py::Owner" in renamed and "a/owner.py::Other" in renamed
    with pytest.raises(ValueError):
        e.submit("a/user.py::use", "See the source `for")
    (tmp_path / "a/user.py").unlink()
    gone = Engine.build(spark, str(tmp_path)).orphaned().collect()
    assert {(r.id, r.kind) for r in gone} == {("a/user.py", "document")}


def test_backfill_and_fingerprints(spark, tmp_path):
    write(tmp_path, {"a/owner.py": "class Owner:\n    x: int\n", "a/user.py": "from a.owner import Owner\n\ndef use():\n    return Owner()\n"})
    e = Engine.build(spark, str(tmp_path))
    for id_ in ("a/user.py::use", "a/user.py", "a/owner.py::Owner", "a/owner.py"):
        e.submit(id_, f"What {id_} does here", "It does that")
    docs = {d.id: d for d in D.load(str(tmp_path))[0]}
    whole = sorted(docs["a/user.py"].dep_targets)
    assert {o for o, _, _ in whole} == {"a/user.py", "a/user.py::use"} and e.backfill_dep_targets() == 0
    docs["a/user.py"].dep_targets = [t for t in whole if t[0] == "a/user.py"]
    docs["a/owner.py"].fingerprint = "older"
    D.write(str(tmp_path), docs["a/user.py"])
    D.write(str(tmp_path), docs["a/owner.py"])
    assert e.backfill_dep_targets() == 1 and e.migrate_fingerprints() == 1
    again = {d.id: d for d in D.load(str(tmp_path))[0]}
    assert sorted(again["a/user.py"].dep_targets) == whole and again["a/owner.py"].fingerprint != "older"
    assert e.backfill_dep_targets() == 0 == e.migrate_fingerprints()


def test_features_system_adoption(spark, tmp_path):
    write(tmp_path, {k: v for k, v in FASTAPI.items() if k.startswith("app/")})
    e = Engine.build(spark, str(tmp_path))
    assert {(r.kind, r.status) for r in e.upper_status().collect()} == {("feature", "missing"), ("system", "missing")}
    with pytest.raises(ValueError):
        e.submit_system("All of it")
    for entry in ("http-get-api-items", "http-get-api-items-2"):
        e.submit_feature(entry, "Lists the items")
    e.submit_system("All of it")
    assert {r.status for r in e.upper_status().collect()} == {"current"}
    e.submit("app/deps.py::get_db", "Opens the database", "Returns one")
    text = (tmp_path / "app/deps.py").read_text()
    write(tmp_path, {"app/store.py": "def get_db():\n    return 1\n", "app/deps.py": text.replace("def get_db():\n    return 1\n\n", "")})
    moved = Engine.build(spark, str(tmp_path))
    assert {(r.id, r.successor, r.disposition) for r in moved.adoption_plan().collect()} == {("app/deps.py::get_db", "app/store.py::get_db", "adopt")}
    assert moved.adopt() == [("app/deps.py::get_db", "app/store.py::get_db")]
    docs = {d.id: d for d in D.load(str(tmp_path))[0]}
    assert docs["app/store.py"].sections["app/store.py::get_db"]["summary"] == "Opens the database"
    assert "app/deps.py::get_db" not in docs["app/deps.py"].sections if "app/deps.py" in docs else True
    assert "stale" in {r.status for r in moved.upper_status().collect()}


def test_incremental_equals_full(spark, tmp_path):
    write(tmp_path / "r", {"a.py": "def a():\n    return 1\n", "b.py": "from a import a\n"})
    e = Engine.build(spark, str(tmp_path / "r"))
    I.save(e.index, str(tmp_path / "cache"))
    write(tmp_path / "r", {"a.py": "def a():\n    return 2\n", "c.py": "x = 1\n"})
    (tmp_path / "r/b.py").unlink()
    again, full = Engine.open(spark, str(tmp_path / "r"), str(tmp_path / "cache")), Engine.build(spark, str(tmp_path / "r"))
    assert sorted(r.source_hash for r in again.rel.files.collect()) == sorted(r.source_hash for r in full.rel.files.collect())
    assert I.load(spark, str(tmp_path / "cache"), "rust") is None and I.load(spark, str(tmp_path / "none"), "python") is None


def test_typescript_feature(spark, tmp_path):
    write(tmp_path, {
        "app/submit/page.tsx": 'import { save } from "@/lib/save";\nimport Form from "./Form";\nexport default function Page() { save(); return <Form a={1} />; }\n',
        "app/submit/Form.tsx": 'export default function Form() { fetch("/api/art/7?x=1"); return null; }\n',
        "app/api/art/[id]/route.ts": 'import { db } from "@/lib/supabase";\nexport async function POST() { return db.from("arts").select(); }\n',
        "app/api/free/route.ts": "export function GET() {}\n",
        "lib/save.ts": 'export { keep as save } from "./keep";\n',
        "tsconfig.json": '{ "compilerOptions": { // paths\n "baseUrl": ".", "paths": { "@/*": ["./*"], "#lib/*": ["lib/*"], } } }',
        "lib/use.ts": 'import { keep } from "#lib/keep";\n',
        "lib/keep.ts": "export function keep() { return 1; }\n",
        "lib/supabase.ts": "export const db = 1;\n",
        "supabase/schema.sql": "create table arts (id int, name text);\nalter table arts add x int;\n",
    })
    e = Engine.build(spark, str(tmp_path))
    assert e.pack == "typescript"
    got = {(r.from_file, r.imported_name): r.target for r in e.imports.collect()}
    assert got["app/submit/page.tsx", "save"] == "lib/keep.ts::keep"
    assert got["lib/use.ts", "keep"] == "lib/keep.ts::keep"
    flows = {(r.kind, r.raw): r.target for r in e.flows.collect()}
    assert flows["route-literal", "/api/art/7"] == "app/api/art/[id]/route.ts"
    assert flows["table-ref", "arts"] == "supabase/schema.sql::arts"
    assert {r.id for r in e.entry_points().collect()} == {"submit", "api-free"}
    own = {(r.tier, r.target) for r in e.participants().where("entry = 'submit'").collect()}
    assert {("core", "app/submit/Form.tsx"), ("core", "app/api/art/[id]/route.ts"), ("data", "supabase/schema.sql::arts")} <= own
    assert {r.from_file for r in e.get_callers("supabase/schema.sql::arts").collect()} == {"app/api/art/[id]/route.ts"}


def test_java_rust_cpp(spark, tmp_path):
    write(tmp_path / "j", {
        "src/main/java/x/Res.java": 'package x;\nimport y.Repo;\n@Path("/a")\n@ApplicationScoped\npublic class Res {\n  Repo repo;\n  @GET @Path("/b") public String b() { return repo.all() + Near.N; }\n  @Incoming("in") public void on(String s) {}\n}\n',
        "src/main/java/x/Near.java": "package x;\npublic class Near { public static final int N = 1; }\n",
        "target/generated-sources/api/x/Api.java": 'package x;\n@Path("/gen")\npublic interface Api {\n  @POST @Path("/made") String make();\n}\n',
        "src/main/java/x/Impl.java": 'package x;\npublic class Impl implements Other, Api {\n  static final String IN = "chan";\n  public String make() { return null; }\n  @Incoming(IN) public void on(String s) {}\n}\n',
        "src/main/java/y/Repo.java": "package y;\npublic class Repo { public String all() { return null; } }\n",
    })
    j = Engine.build(spark, str(tmp_path / "j"))
    targets = {r.target for r in j.imports.where("from_file LIKE '%Res.java'").collect()}
    assert {"src/main/java/y/Repo.java::Repo", "src/main/java/x/Near.java::Near"} <= targets
    assert {(r.kind, r.title) for r in j.entry_points().collect()} == {("http", "GET /a/b"), ("kafka", "in"), ("http", "POST /gen/made"), ("kafka", "chan")}
    write(tmp_path / "r", {"src/lib.rs": "mod a;\npub use crate::a::Thing;\n", "src/a.rs": "pub struct Thing;\nimpl Thing { pub fn n() {} }\n", "Cargo.toml": '[package]\nname = "my-lib"\n', "src/c.rs": "use my_lib::a::Thing;\n", "src/b.rs": "use crate::Thing;\nfn f() { crate::a::Thing::n(); }\n"})
    r = Engine.build(spark, str(tmp_path / "r"))
    assert {(x.from_file, x.target) for x in r.imports.where("target IS NOT NULL").collect()} >= {("src/b.rs", "src/a.rs::Thing"), ("src/c.rs", "src/a.rs::Thing"), ("src/lib.rs", "src/a.rs::Thing")}
    write(tmp_path / "c", {"include/a.h": '#include "b.h"\nint fa(int);\n', "include/b.h": '#include "a.h"\nclass Bee { public: int n(); };\nenum class Color { kRed };\n', "src/m.cc": '#include "a.h"\nint main() { Bee b; return fa(1); }\n'})
    c = Engine.build(spark, str(tmp_path / "c"))
    assert {x.target for x in c.imports.where("form = 'word' AND from_file = 'src/m.cc'").collect()} == {"include/a.h::fa", "include/b.h::Bee"}
    assert c.statistics().count() > 3


def test_documents_round_trip():
    doc = D.Document("file", "a/b.py", "Sum\nmore", "1", "2", "3", "4", dep_targets=[("a/b.py::f", "c.py::g", "abc")], sections={"a/b.py::f": {"source_hash": "5", "deps_hash": "6", "spec_hash": "7", "summary": "S", "behavior": "B\nC"}})
    assert D.parse(D.render(doc)) == doc
    roll = D.Document("rollup", "rollup:a", "R", spec_hash="9", children=[("a/b.py", "4"), ("a/c = d.py", "")])
    assert D.parse(D.render(roll)) == roll
    with pytest.raises(ValueError):
        D.parse("no front matter")
