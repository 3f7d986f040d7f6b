"""The packs on awkward sources, in plain Python: the same tables as the queries over parts, and more."""

import ast
import random

import pytest
from stratagraph.extract import braces as B
from stratagraph.extract import cpp_macros, cpp_pack, java_pack, model, packs, python_pack, ts_pack
from stratagraph.plans.source_trees import TEMPLATES
from stratagraph.plans.variants import VARIANTS


def flat(symbols):
    return [x for s in symbols for x in [(s.id.split("::", 1)[1], s.kind, s.is_exported, s.start_line, s.end_line), *flat(s.members)]]


def fill(x):
    return x if x is None else x.replace("{k}", "5").replace("{n}", "6").replace("{s}", "7")


@pytest.mark.parametrize(("pack", "at"), [(p, i) for p, v in VARIANTS.items() for i in range(len(v))])
def test_variant(pack, at):
    path, text, symbols, imports = VARIANTS[pack][at]
    e = packs.extract(pack, "code", fill(path), fill(text))
    assert sorted(flat(e.symbols)) == sorted((fill(n), *rest) for n, *rest in symbols)
    assert sorted((i.specifier, i.imported_name or "", i.form) for i in e.imports if i.form != "qualified") == sorted((fill(a), fill(b) or "", c) for a, b, c in imports)


TS = [
    ("export function a() { return 1 }\nexport { x } from './y'\n", ["a"], [("./y", "x")]),
    ("/* import a from 'b' */\nconst t = 1", ["t"], []),
    ("const s = `import q from 'r'`", ["s"], []),
    ("export default class { go() {} }", [], []),
    ("export default () => 1\n", [], []),
    ("export default function Page() {}", ["Page"], []),
    ("const a = 1, b = 2", ["a", "b"], []),
    ("const a = f(1, 2), b = { c: 1, d: [2, 3] }", ["a", "b"], []),
    ("let a = 1; var b = 2", [], []),
    ("namespace N { export const x = 1 }", [], []),
    ("import * as ns from 'n'", [], []),
    ("import d, { e } from './d'; import './side'", [], [("./d", "default"), ("./d", "e")]),
    ("const m: Map<string, number> = new Map(), z = 1", ["m", "z"], []),
    ("const { a, b: { c }, ...d } = x", ["a", "c", "d"], []),
    ("type A = | 'x'\n  | 'y'\ninterface B {}", ["A", "B"], []),
    ("declare function f(): void;\nabstract class C {}\nenum D { E }", ["f", "C", "D"], []),
    ("if (x) { function inner() {} }\nfunction outer() { const q = 1 }", ["outer"], []),
    ("export const handler = async (req: Request): Promise<{ a: 1 }> => {\n  return { a: 1 }\n}\nexport const next = 1", ["handler", "next"], []),
]


@pytest.mark.parametrize(("source", "names", "imports"), TS)
def test_typescript(source, names, imports):
    e = ts_pack.extract("a.ts", source)
    assert sorted(s.id.partition("::")[2] for s in e.symbols) == sorted(names)
    assert [(i.specifier, i.imported_name) for i in e.imports] == imports


CPP = [
    ("class ALIGN(8) Q { };", ["Q"]),
    ("class EXPORT Q : public B { };", ["Q"]),
    ("class ALIGN(8) Q10 { Q10& go(); };", ["Q10", "Q10::go"]),
    ("class DLL_API QUEUE final { };", ["QUEUE"]),
    ("template <typename T, bool B = (sizeof(T) > 4)> class Foo { int x; };", ["Foo", "Foo::x"]),
    ("template <> struct S<int> { };", ["S"]),
    ("template <class T> requires C<T> T f(T t);", ["f"]),
    ("auto f = [](int x) { return x; };", ["f"]),
    ("int a[] = {1, 2}, *b;", ["a", "b"]),
    ("typedef struct { int q; } TD;", ["TD", "TD::q"]),
    ("extern \"C\" { void c(); }", ["c"]),
    ("class X; enum E : int; struct Y { };", ["Y"]),
    ("void f() OVERRIDE; int g(int x) NOEXCEPT;", ["f", "g"]),
    ("struct S { int m GUARDED_BY(mu); void h() const LOCKS(mu); };", ["S", "S::m", "S::h"]),
    ("namespace a { inline namespace v1 { int f(); } }", ["a::f"]),
    ("STATIC_CHECK(x);\nint y;", ["y"]),
    ("NAMESPACE_BEGIN\nint y;\nNAMESPACE_END\n", ["y"]),
    ("struct S { S() : a{1} {} ~S(); S& operator=(S&&) = default; bool operator()(int) const; explicit operator bool(); int a; };", ["S", "S::S", "S::~S", "S::operator=", "S::operator()", "S::operator bool", "S::a"]),
    ("int f(int (*cb)(int), std::function<int(int)> g);", ["f"]),
    ("#if A\nint f() {\n#else\nint f(int) {\n#endif\n return 1; }\nint g();", ["f", "g"]),
    ("enum Color {\n RED,\n GREEN\n};", ["Color", "Color::RED", "Color::GREEN"]),
    ("SIZE x; HANDLE Open(int);", ["x", "Open"]),
]


@pytest.mark.parametrize(("source", "names"), CPP)
def test_cpp(source, names):
    assert sorted(n for n, *_ in flat(cpp_pack.extract("a.h", source).symbols)) == sorted(names)


@pytest.mark.parametrize("source", [c[0] for c in CPP])
def test_blanking_keeps_places(source):
    out = cpp_macros.blank_macros(cpp_macros.blank_templates(source))
    assert len(out) == len(source) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]
    assert all(a == b or a == " " for a, b in zip(out, source))


JAVA = [
    ("class A { static { x = 1; } { y(); } }", ["A"]),
    ("class A { int a, b[] = {1}, c = f(1, 2); }", ["A", "A::a", "A::b", "A::c"]),
    ("record R(int a) { R { check(a); } }", ["R", "R::<init>"]),
    ("class A { A() {} A(int x) {} void A2() {} }", ["A", "A::<init>", "A::<init>#2", "A::A2"]),
    ("enum E { A, B(1) { void x() {} }; int v; }", ["E", "E::A", "E::B", "E::v"]),
    ("interface I<T> { Map<String, List<T>> M = null; <R> R go(R r); }", ["I", "I::M", "I::go"]),
    ("class A { Runnable r = () -> { int z; }; int after; }", ["A", "A::r", "A::after"]),
    ("@interface N { int v() default 1; }", ["N", "N::v"]),
    ("class A { class B { class C { int d; } } }", ["A", "A::B", "A::B::C", "A::B::C::d"]),
    ("class A { @X(y = {1, 2}) private final int q = 1; }", ["A", "A::q"]),
    ("class A { String s = \"{;\"; char c = '}'; /* } */ int z; }", ["A", "A::s", "A::c", "A::z"]),
    ("sealed class A permits B { } non-sealed class B extends A { }", ["A", "B"]),
    ("class A { int[] f() { return new int[] {1}; } int[] g; }", ["A", "A::f", "A::g"]),
    ("class A { abstract <T extends B & C> void m(T... t) throws D; }", ["A", "A::m"]),
    ("class A { static int x; static void y() {} static class Z {} }", ["A", "A::x", "A::y", "A::Z"]),
]


@pytest.mark.parametrize(("source", "names"), JAVA)
def test_java(source, names):
    assert sorted(n for n, *_ in flat(java_pack.extract("p/A.java", source).symbols)) == sorted(names)


NESTING = ["try:\n    import a\nexcept E:\n    import b\n    def f():\n        import c\nelse:\n    import d\nfinally:\n    import e\n", "match x:\n    case 1:\n        import a\n    case _:\n        if y:\n            import b\n        else:\n            import c\nclass C:\n    import d\n    async def g(self):\n        async with z:\n            from e import f\nimport h\n"]


@pytest.mark.parametrize("source", NESTING)
def test_statements_come_in_the_order_of_a_whole_walk(source):
    tree = ast.parse(source)
    kinds = ast.stmt | ast.ExceptHandler | ast.match_case | ast.Module
    assert list(python_pack.statements(tree)) == [n for n in ast.walk(tree) if isinstance(n, kinds)]


@pytest.mark.parametrize("pack", ["python", "typescript"])
def test_flows_alone_make_no_symbols(pack):
    path, text = (x.format(k=1, n=2, s=5, t="True") for x in TEMPLATES[pack])
    whole, flows = packs.extract(pack, "code", path, text), packs.extract(pack, "code", path, text, None, ("flows",))
    assert flows.flows == whole.flows != [] and whole.symbols and not flows.symbols
    assert (flows.fingerprint, flows.parse_errors) == (whole.fingerprint, whole.parse_errors)


def _closed(clean, at):
    stack = []
    for i in range(at, len(clean)):
        if clean[i] in "([{":
            stack.append({"(": ")", "[": "]", "{": "}"}[clean[i]])
        elif clean[i] in ")]}":
            if stack.pop() != clean[i]:
                return -1
            if not stack:
                return i
    return -1


def test_brackets_are_matched_in_one_pass():
    rng = random.Random(3)
    for _ in range(300):
        clean = "".join(rng.choice("(){}[]x") for _ in range(rng.randrange(1, 30)))
        assert all(B.close_of(clean, i) == _closed(clean, i) for i, c in enumerate(clean) if c in "([{")
    B._closings.cache_clear()
    deep = "a{" * 200 + "}" * 200
    assert B.items(deep, 0, len(deep))[0].end == len(deep) and [B.close_of(deep, 2 * k + 1) for k in range(200)] == list(range(599, 399, -1))
    assert B._closings.cache_info().misses == 1


def test_cpp_includes_need_no_declarations(monkeypatch):
    text = '#include "a.h"\n/*\n#include "no.h"\n*/\n#include <b>\nclass FOO_API K { int go(); };\n'
    whole = cpp_pack.extract("src/k.h", text)

    def never(*_):
        raise AssertionError("declarations are read")

    monkeypatch.setattr(cpp_macros, "blank_macros", never)
    alone = packs.extract("cpp", "code", "src/k.h", text, None, ("imports",))
    assert alone.imports == whole.imports and [i.specifier for i in alone.imports] == ["a.h", "b"]
    assert (alone.symbols, alone.words, alone.parse_errors) == ([], [], None)
    assert packs.extract("cpp", "code", "src/k.h", text, None, ("words",)).words == whole.words


@pytest.mark.parametrize("pack", sorted(VARIANTS))
def test_places_are_those_of_whole_symbols(monkeypatch, pack):
    files = [(fill(path), fill(text)) for path, text, _, _ in VARIANTS[pack]]
    flat_ = lambda e, names=(): [{k: r[k] for k in (*model.PLACES, "ord", "is_top_level")} for r in model.rows(e.symbols, names)]
    whole = [flat_(packs.extract(pack, "code", *f)) for f in files]
    if pack == "cpp":
        monkeypatch.setattr("stratagraph.extract.braces.doc_before", None)  # no comment is looked for
    assert [flat_(packs.extract(pack, "code", *f, None, ("places",)), model.PLACES) for f in files] == whole and all(whole)


def test_rules_that_cannot_hold_are_not_tried(monkeypatch):
    """A text without attributes, modules, templates, labels or calls of macros takes none of the slow patterns."""
    for name in ("_ATTRIBUTE", "_INSTANCE", "_MODULE", "_LABEL", "_MEMBER"):
        monkeypatch.setattr(cpp_macros, name, None)
    text = "class Foo {\n public:\n  int go(int a);\n};\n"
    assert cpp_macros.blank_macros(text) == text
    with pytest.raises((AttributeError, TypeError)):
        cpp_macros.blank_macros(text + "export int a;\n")
