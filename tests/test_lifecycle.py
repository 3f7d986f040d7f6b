"""One owner, one consumer, one that is unrelated, in each language: which documents an edit makes stale."""

import pytest
from stratagraph.engine import Engine
from stratagraph.sources import documents as D
from test_engine import write

OWNERS = {
    "typescript": (
        "lib/owner.ts", "lib/consumer.ts::use", "lib/other.ts::alone",
        {"lib/owner.ts": "export class Owner {\n  size: number = 1\n  private secret = 2\n  go(n: number): number { return 1 }\n}\n", "lib/consumer.ts": 'import { Owner } from "./owner"\nexport function use() { return new Owner() }\n', "lib/other.ts": "export function alone() { return 3 }\n"},
        {"body": ("return 1", "return 9"), "private": ("secret = 2", "secret = 5"), "type": ("size: number = 1", "size: string = 1"), "added": ("  go(n", "  more: number = 1\n  go(n"), "signature": ("go(n: number)", "go(n: number, m: number)")},
    ),
    "rust": (
        "src/owner.rs", "src/consumer.rs::run", "src/other.rs::alone",
        {"Cargo.toml": "[package]\nname = \"x\"\n", "src/lib.rs": "mod owner;\nmod consumer;\nmod other;\n", "src/owner.rs": "pub struct Owner { pub size: u8, secret: u8 }\nimpl Owner {\n    pub fn go(&self, n: u8) -> u8 { 11 }\n}\n", "src/consumer.rs": "use crate::owner::Owner;\npub fn run(o: Owner) -> u8 { 1 }\n", "src/other.rs": "pub fn alone() -> u8 { 3 }\n"},
        {"body": ("{ 11 }", "{ 19 }"), "private": ("secret: u8", "secret: u16"), "type": ("pub size: u8", "pub size: u32"), "added": ("pub size: u8", "pub more: u8, pub size: u8"), "signature": ("n: u8)", "n: u8, m: u8)")},
    ),
    "java": (
        "src/main/java/p/Owner.java", "src/main/java/q/Consumer.java::Consumer", "src/main/java/q/Other.java::Other",
        {"src/main/java/p/Owner.java": "package p;\npublic class Owner {\n  public int size = 1;\n  private int secret = 2;\n  public int go(int n) { return 1; }\n}\n", "src/main/java/q/Consumer.java": "package q;\nimport p.Owner;\npublic class Consumer { Owner o; }\n", "src/main/java/q/Other.java": "package q;\npublic class Other { int x; }\n"},
        {"body": ("return 1;", "return 9;"), "private": ("secret = 2", "secret = 5"), "type": ("public int size", "public long size"), "added": ("  public int go", "  public int more;\n  public int go"), "signature": ("go(int n)", "go(int n, int m)")},
    ),
    "cpp": (
        "inc/owner.h", "src/consumer.cc::use", "src/other.cc::alone",
        {"inc/owner.h": "class Owner {\n public:\n  int size;\n  int go(int n);\n private:\n  int secret;\n};\n", "src/owner.cc": '#include "../inc/owner.h"\nint Owner::go(int n) { return 1; }\n', "src/consumer.cc": '#include "../inc/owner.h"\nint use() { Owner o; return 2; }\n', "src/other.cc": "int alone() { return 3; }\n"},
        {"body": ("return 1;", "return 9;"), "private": ("int secret", "long secret"), "type": ("int size", "long size"), "added": ("  int size;", "  int size;\n  int more;"), "signature": ("int go(int n);", "int go(int n, int m);")},
    ),
}


@pytest.mark.parametrize("pack", OWNERS)
def test_edits(spark, tmp_path, pack):
    owner, consumer, other, files, edits = OWNERS[pack]

    def hashes(changed):
        write(tmp_path, changed)
        return {r.id: (r.source_hash, r.deps_hash) for r in Engine.build(spark, str(tmp_path), pack).hashes().collect()}

    before = hashes(files)
    assert f"{owner}::Owner" in before and consumer in before and other in before
    for name, (old, new) in edits.items():
        after = hashes({k: v.replace(old, new) if "wner" in k else v for k, v in files.items()})
        stale = {i for i in before if before[i] != after.get(i)}
        assert f"{owner}::Owner" in stale, (name, stale)
        assert (consumer in stale) == (name in ("type", "added", "signature")), (name, stale)
        assert other not in stale, (name, stale)


def test_definitions_join_their_declarations(spark, tmp_path):
    write(tmp_path, OWNERS["cpp"][3] | {"src/free.cc": "int lone() { return 4; }\n"})
    e = Engine.build(spark, str(tmp_path), "cpp")
    ids = {r.id for r in e.rel.symbols.select("id").collect()}
    assert "inc/owner.h::Owner::go" in ids and "src/owner.cc::Owner::go" not in ids and "src/free.cc::lone" in ids
    assert {(r.target, r.file, r.start_line) for r in e.spans.collect()} == {("inc/owner.h::Owner::go", "src/owner.cc", 2)}
    assert "inc/owner.h::Owner" in {r.target for r in e.imports.where("from_file = 'src/consumer.cc'").collect()}


def test_stored_links_and_tasks(spark, tmp_path):
    write(tmp_path, {"a/one.py": "def f():\n    return 1\n", "a/two.py": "from a.one import f\n\ndef g():\n    return f()\n"})
    cache = str(tmp_path.parent / f"{tmp_path.name}-cache")
    e = Engine.build(spark, str(tmp_path))
    e.save(cache)
    again = Engine.open(spark, str(tmp_path), cache)
    assert "parquet" in again.imports._jdf.queryExecution().toString().lower()  # read, not resolved
    assert {(r.from_file, r.target) for r in again.imports.collect()} == {(r.from_file, r.target) for r in e.imports.collect()}
    write(tmp_path, {"a/one.py": "def f2():\n    return 1\n"})
    moved = Engine.open(spark, str(tmp_path), cache)
    assert {r.target for r in moved.imports.collect()} == {None} or "a/one.py::f" not in {r.target for r in moved.imports.collect()}
    write(tmp_path, {"a/one.py": "def f():\n    return 1\n"})
    assert e.next_unit()["id"] == "a/one.py::f" and e.next_unit("a")["id"] == "a/one.py::f"
    assert e.next_unit("a", cursor=1)["id"] == "a/two.py::g"
    for i in ("a/one.py::f", "a/one.py", "a/two.py::g", "a/two.py"):
        e.submit(i, f"What {i} does is this", "And it does that too")
    text = (tmp_path / D.ROOT / "a/two.py.md").read_text()
    assert "`def g()`" in text and "- [`a/one.py::f`](one.py.md#f)" in text and D.PROVENANCE in text
    assert e.next_unit("a")["id"] == "rollup:a" and e.next_unit()["kind"] == "rollup"
    e.submit_rollup("a", "All of the folder a here")
    rolled = (tmp_path / D.ROOT / "a/_index.md").read_text()
    assert "## Contents" in rolled and "- [`a/one.py`](one.py.md) — What a/one.py does is this" in rolled
    assert e.next_unit("a") is None and e.next_unit()["kind"] == "system"
    e.submit_system("The whole of the system here")
    assert "## Modules" in (tmp_path / D.ROOT / "_index.md").read_text() and e.next_unit() is None
    assert e.migrate_documents() == 0


def test_migration(tmp_path, spark):
    old = "---\ntype: file\nsource: a.py\nhashes: { source_hash: x, spec_hash: y }\ndeps:\n  a.py::f -> b.py::g = 123\n---\n## Summary\nIt is old. See [b](../specs/b.md).\n"
    write(tmp_path, {"a.py": "x = 1\n", f"{D.ROOT}/a.py.md": old})
    e = Engine.build(spark, str(tmp_path))
    assert (e.migrate_documents(), e.migrate_documents()) == (1, 0)
    doc = D.load(str(tmp_path))[0][0]
    assert (doc.kind, doc.id, doc.source_hash, doc.summary, doc.dep_targets) == ("file", "a.py", "x", "It is old. See [b](../b.md).", [("a.py::f", "b.py::g", "123")])


@pytest.mark.parametrize("value", ["a", "a b", "a: b", "", " x", 'q"r\\s', "true", "#x", "line\nbreak", "[a]", "x y/z.py::C", "é"])
def test_quoting(value):
    assert D.unquoted(D.quoted(value)) == value
    assert "\n" not in D.quoted(value)
