"""Awkward sources: further file shapes per language, each beside the symbols and imports that it must give.

``{k}`` is a part's key and ``{n}`` the next part's. Symbols: (name, kind, exported, first line, last line).
Imports: (specifier, imported name, form).
"""

from __future__ import annotations

C, V, F, S = "container", "value", "callable", "schema"

VARIANTS: dict[str, list[tuple[str, str, list, list]]] = {
    "typescript": [
        (
            "lib/a{k}.ts",
            'export function a{k}() { return {s} }\nexport { x } from "./y{n}"\nimport z, { type T as U, w } from "./z{k}"\n/* import gone from "./gone" */\nconst s = `import q from "./q"`\nconst b{k} = 1, c = (x: number): number => {\n  return x\n}\n',
            [("a{k}", F, True, 1, 1), ("s", V, False, 5, 5), ("b{k}", V, False, 6, 6), ("c", F, False, 6, 8)],
            [("./y{n}", "x", "reexport"), ("./z{k}", "default", "default"), ("./z{k}", "T", "named"), ("./z{k}", "w", "named")],
        ),
        (
            "lib/b{k}.ts",
            'import * as ns from "./ns{k}"\nexport * from "./all"\nexport default class { go() {} }\nnamespace N { export const hidden = 1 }\nconst { auth{k}, h: { GET }, d = 3, ...rest } = f({ a: 1 })\nlet no = 1\nabstract class Q{k} extends B<{ x: 1 }> {\n  static n = 1\n  #p = "}"\n  abstract go(): void\n  get v() { return 1 }\n}\nfunction over{k}(a: string): void\nfunction over{k}(a: any) {}\nexport { Q{k} as default, over{k} }\n',
            [("auth{k}", V, False, 5, 5), ("GET", V, False, 5, 5), ("d", V, False, 5, 5), ("rest", V, False, 5, 5), ("Q{k}", C, True, 7, 12), ("Q{k}.n", V, True, 8, 8), ("Q{k}.#p", V, False, 9, 9), ("Q{k}.go", F, True, 10, 10), ("Q{k}.v", F, True, 11, 11), ("over{k}", F, True, 14, 14)],
            [],
        ),
        (
            "lib/c{k}.tsx",
            'import type { P } from "@/t{k}"; import D from "./d{k}"\nexport type T{k} = { a: string }\n  | { b: number }\nexport interface I{k} extends P {\n  m(): void\n}\nexport const enum E{k} { A, B }\nexport const h = <X,>(x: X): x is X => true\nexport async function* gen(a: { x: 1 }): AsyncGenerator<{ y: 2 }> {\n  yield a\n}\nconst r = cond\n  ? 1\n  : 2\n',
            [("T{k}", V, True, 2, 3), ("I{k}", V, True, 4, 6), ("E{k}", V, True, 7, 7), ("h", F, True, 8, 8), ("gen", F, True, 9, 11), ("r", V, False, 12, 14)],
            [("@/t{k}", "P", "named"), ("./d{k}", "default", "default")],
        ),
    ],
    "cpp": [
        (
            "src/a{k}.h",
            '#include <vector>\n#include "b{n}.h"\ntemplate <typename T, bool B = (sizeof(T) > 4)>\nclass Foo{k} : public Bar<T> {\n  void f(std::function<void(int)> g);\n};\ntemplate <> struct S{k}<int> { int x, y; };\ntypedef struct { int a; } TD{k};\nextern template class Foo{k}<int>;\nclass ALIGN(8) Q{k} {\n public:\n  Q{k}& operator=(const Q{k}&) { return *this; }\n  int m_ GUARDED_BY(mu_);\n  int go() const OVERRIDE;\n};\n',
            [("Foo{k}", C, True, 3, 6), ("Foo{k}::f", F, False, 5, 5), ("S{k}", C, True, 7, 7), ("S{k}::x", V, False, 7, 7), ("S{k}::y", V, False, 7, 7), ("TD{k}", C, True, 8, 8), ("TD{k}::a", V, False, 8, 8), ("Q{k}", C, True, 10, 15), ("Q{k}::operator=", F, False, 12, 12), ("Q{k}::m_", V, False, 13, 13), ("Q{k}::go", F, False, 14, 14)],
            [("vector", None, "include"), ("b{n}.h", None, "include")],
        ),
        (
            "src/b{k}.cc",
            'namespace a::b { inline namespace v1 {\nenum { A{k} = 1, B };\nenum class E{k} : int { C, D = f(1, 2) };\n} }\nnamespace { int hid; }\nint T{k}::m(int) const { return {s}; }\nauto f{k} = [](int x) { return x; };\nint arr[3] = {1, 2, 3};\nstatic int s1, s2;\nDISALLOW_COPY(Z);\n#ifdef X\nstruct W{k} : B {\n#else\nstruct W{k} {\n#endif\n  int q;\n};\n',
            [("a::b::A{k}", V, True, 2, 2), ("a::b::B", V, True, 2, 2), ("a::b::E{k}", C, True, 3, 3), ("a::b::E{k}::C", V, False, 3, 3), ("a::b::E{k}::D", V, False, 3, 3), ("hid", V, False, 5, 5), ("T{k}::m", F, True, 6, 6), ("f{k}", V, True, 7, 7), ("arr", V, True, 8, 8), ("s1", V, False, 9, 9), ("s2", V, False, 9, 9), ("W{k}", C, True, 12, 17), ("W{k}::q", V, False, 16, 16)],
            [],
        ),
        (
            "src/c{k}.hpp",
            '#pragma once\nAPI_EXPORT void f{k}();\nNAMESPACE_BEGIN\nclass EXPORT_API Z{k} final : Y {\n  Q_OBJECT\n public slots:\n  void s();\n private:\n  union { int u1; float u2; };\n  friend class W;\n  using Base::foo;\n  struct In { int z; };\n};\nNAMESPACE_END\n#define MAX{k}(a) (a)\n[[nodiscard]] inline int h{k}(int a) { return a; }\nvoid (*fp)(int);\nusing Map{k} = std::map<int, std::string>;\n',
            [("MAX{k}", F, True, 15, 15), ("f{k}", F, True, 2, 2), ("Z{k}", C, True, 4, 13), ("Z{k}::s", F, False, 7, 7), ("Z{k}::u1", V, False, 9, 9), ("Z{k}::u2", V, False, 9, 9), ("Z{k}::In", C, False, 12, 12), ("Z{k}::In::z", V, False, 12, 12), ("h{k}", F, True, 16, 16), ("fp", V, True, 17, 17), ("Map{k}", V, True, 18, 18)],
            [],
        ),
    ],
    "java": [
        (
            "src/main/java/q/A{k}.java",
            'package q;\nimport static p.J{k}.go;\nimport java.util.*;\npublic class A{k}<T extends Comparable<T>> {\n  static { x = 1; }\n  { y = 2; }\n  int a, b = 2, c[];\n  private static final Map<String, List<Integer>> M = new HashMap<>() {{ put("a", 1); }};\n  public A{k}(int a) {}\n  @Override public <R> R go(Map<String, R> m) throws E { return null; }\n}\n',
            [("A{k}", C, True, 4, 11), ("A{k}::a", V, True, 7, 7), ("A{k}::b", V, True, 7, 7), ("A{k}::c", V, True, 7, 7), ("A{k}::M", V, False, 8, 8), ("A{k}::<init>", F, True, 9, 9), ("A{k}::go", F, True, 10, 10)],
            [("p.J{k}", "go", "named"), ("java.util", "*", "star")],
        ),
        (
            "src/main/java/q/R{k}.java",
            'package q;\npublic record R{k}(int a, int b) {\n  public R{k} { if (a < 0) throw new X(); }\n  static int of() { return 1; }\n  enum K { A(1) { void z() {} }, B(2); private final int v; K(int v) { this.v = v; } }\n}\n',
            [("R{k}", C, True, 2, 6), ("R{k}::<init>", F, True, 3, 3), ("R{k}::of", F, True, 4, 4), ("R{k}::K", C, False, 5, 5), ("R{k}::K::A", V, False, 5, 5), ("R{k}::K::B", V, False, 5, 5), ("R{k}::K::v", V, False, 5, 5), ("R{k}::K::<init>", F, False, 5, 5)],
            [],
        ),
        (
            "src/main/java/q/S{k}.java",
            'package q;\npublic sealed interface S{k} permits R {\n  int K = 1;\n  default void d() { /* } */ }\n  @interface Ann { String value() default "x"; }\n}\nclass C{k} { String s = "a;b{"; char c = \';\'; int[] arr = {1, 2}, more; Runnable r = () -> { go(); }; }\n',
            [("S{k}", C, True, 2, 6), ("S{k}::K", V, True, 3, 3), ("S{k}::d", F, True, 4, 4), ("S{k}::Ann", C, False, 5, 5), ("S{k}::Ann::value", F, False, 5, 5), ("C{k}", C, False, 7, 7), ("C{k}::s", V, False, 7, 7), ("C{k}::c", V, False, 7, 7), ("C{k}::arr", V, False, 7, 7), ("C{k}::more", V, False, 7, 7), ("C{k}::r", V, False, 7, 7)],
            [],
        ),
    ],
    "python": [
        (
            "q/a{k}.py",
            'from __future__ import annotations\nfrom . import b{n}\nfrom ..p.m{k} import (\n    C{k} as D,\n)\nX{k}: int = 1\na, (b, c) = 1, (2, 3)\n\n@deco\n@other(1)\nasync def f{k}(x, *, y=1):\n    def inner():\n        pass\n\nclass K{k}(Base):\n    z = 1\n    @property\n    def p(self):\n        return 1\n    @p.setter\n    def p(self, v):\n        pass\n    class In:\n        q = 2\n',
            [("X{k}", V, True, 6, 6), ("a", V, True, 7, 7), ("f{k}", F, True, 9, 13), ("K{k}", S, True, 15, 24), ("K{k}::z", V, True, 16, 16), ("K{k}::p", F, True, 17, 19), ("K{k}::p#2", F, True, 20, 22), ("K{k}::In", C, True, 23, 24), ("K{k}::In::q", V, True, 24, 24)],
            [("__future__", "annotations", "named"), (".", "b{n}", "named"), ("..p.m{k}", "C{k}", "named")],
        ),
        (
            "q/b{k}.py",
            'import a.b{k} as x, c\nfrom d import *\nif T:\n    from e import f{k}\n\ndef g(a: "str" = "def no(): pass") -> int:\n    return 1\n_h = g\nclass _P:\n    """class X: pass"""\n    def __init__(self): ...\n    def _q(self): ...\n',
            [("g", F, True, 6, 7), ("_h", V, False, 8, 8), ("_P", C, False, 9, 12), ("_P::__init__", F, False, 11, 11), ("_P::_q", F, False, 12, 12)],
            [("a.b{k}", None, "module"), ("c", None, "module"), ("d", "*", "star"), ("e", "f{k}", "named")],
        ),
    ],
    "rust": [
        (
            "src/q/a{k}.rs",
            'use std::{fmt, io::{self, Read as R}};\npub use super::b{n}::Z;\npub(crate) const K{k}: &str = "fn no() {}";\n#[derive(Clone)]\npub enum E{k}<\'a, T> { A(&\'a T), B { x: u8 } }\npub trait Tr{k} { fn go(&self); fn dflt(&self) -> char { \'{\' } }\nimpl<T> Tr{k} for E{k}<\'_, T> { fn go(&self) {} }\npub async unsafe fn f{k}<F: Fn(u8) -> u8>(f: F) -> impl Fn() { move || {} }\nmacro_rules! m{k} { () => { struct X; } }\n',
            [("K{k}", V, True, 3, 3), ("E{k}", C, True, 4, 5), ("E{k}::A", V, True, 5, 5), ("E{k}::B", V, True, 5, 5), ("Tr{k}", C, True, 6, 6), ("Tr{k}::go", F, True, 6, 6), ("Tr{k}::dflt", F, True, 6, 6), ("E{k} as Tr{k}", C, True, 7, 7), ("E{k} as Tr{k}::go", F, True, 7, 7), ("f{k}", F, True, 8, 8), ("m{k}", F, False, 9, 9)],
            [("std", "fmt", "named"), ("std", "io", "named"), ("std::io", "Read", "named"), ("super::b{n}", "Z", "reexport")],
        ),
        (
            "src/q/b{k}.rs",
            'mod inner{k} { pub fn deep() {} pub struct D; }\nimpl super::a{n}::E { pub const N: u8 = 1; fn hid() {} }\npub union U{k} { a: u8, b: u16 }\nstatic mut G: [u8; 2] = [1, 2];\ntype L = Vec<u8>;\nextern "C" { fn c_fn(); }\n/* nested /* } */ */\nconst fn q{k}() -> &\'static str { r#"}"# }\n#[cfg(test)]\nmod tests { fn t() {} }\n',
            [("inner{k}", C, False, 1, 1), ("inner{k}::deep", F, True, 1, 1), ("inner{k}::D", C, True, 1, 1), ("E", C, True, 2, 2), ("E::N", V, True, 2, 2), ("E::hid", F, False, 2, 2), ("U{k}", C, True, 3, 3), ("U{k}::a", V, False, 3, 3), ("U{k}::b", V, False, 3, 3), ("G", V, False, 4, 4), ("L", V, False, 5, 5), ("q{k}", F, False, 8, 8)],
            [],
        ),
    ],
}
