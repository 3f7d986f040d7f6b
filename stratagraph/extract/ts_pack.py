"""TypeScript files: declarations, imports and framework links."""

from __future__ import annotations

import posixpath
import re

from stratagraph.extract import braces as B
from stratagraph.extract.model import PARTS, Extracted, Import, Symbol, digest, fold_same_id, number_repeats

_DECL = re.compile(
    r"(?m)(?:^|(?<=[;}]))[ \t]*(?P<head>(?P<export>export\s+)?(?P<default>default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"
    r"(?P<what>function\s*\*?|class|interface|enum|const\s+enum|type|const)(?:(?<=\*)|(?<=\* )|(?<=\w))\s*(?<![\w$](?=[\w$]))(?P<name>[A-Za-z_$][\w$]*|\{|\[))"
)
_STATEMENT = re.compile(r"(?<![\w$.])(import|export)\b(?!\s*[(.:=])")
_CLAUSE = {
    "import": re.compile(r"\s*(?:type\s+(?=[\w$*{]))?(?P<what>(?:[A-Za-z_$][\w$]*\s*(?:,\s*)?)?(?:\{[^{}]*\}|\*\s*as\s+[\w$]+)?)\s*\bfrom\s*(?P<q>['\"])"),
    "export": re.compile(r"\s*(?:type\s+)?(?P<what>\{[^{}]*\}|\*(?:\s*as\s+[\w$]+)?)\s*from\s*(?P<q>['\"])"),
}
_BARE = re.compile(r"(?<![\w$.])export\s*(?:type\s*)?\{([^{}]*)\}(?!\s*from\b)")
_MEMBER = re.compile(r"^(?P<mods>(?:(?:public|private|protected|static|readonly|abstract|async|override|declare|get|set)\s+)*)(?P<name>[#A-Za-z_$][\w$]*|constructor)\s*(?P<rest>[?!]?\s*(?:[(<:=]|$))")
_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
_FETCH = re.compile(r"\bfetch\(\s*(['\"`])(/api/[^'\"`]*)\1")
_TABLE = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)?(?:\([^()]*\))?\s*\.from\(\s*(['\"])([a-z][a-z0-9_]*)\2\s*\)")
_TAG = re.compile(r"<([A-Z][\w$]*)[\s/>]")


def module_paths(path: str, specifier: str, aliases: dict[str, str] | None = None) -> list[str]:
    if specifier.startswith("."):
        stems = [posixpath.normpath(posixpath.join(posixpath.dirname(path), specifier))]
    else:
        hit = [(a, to) for a, to in (aliases or {"@/": "", "~/": ""}).items() if specifier.startswith(a)]
        stems = [s for a, to in hit for s in (to + specifier[len(a) :], "src/" + specifier[len(a) :])]
    return [p for s in stems for p in ([s] if posixpath.splitext(s)[1] in _EXTENSIONS else []) + [s + e for e in _EXTENSIONS] + [f"{s}/index{e}" for e in _EXTENSIONS[:2]]]


def _names(clause: str) -> list[tuple[str, str]]:
    out = []
    for part in clause.split(","):
        part = re.sub(r"^\s*type\s+", "", part).strip()
        if part:
            name, _, local = part.partition(" as ")
            out.append((name.strip(), (local or name).strip()))
    return out


def _imports(path: str, source: str, clean: str, depth: B.Depths, aliases: dict[str, str] | None) -> list[Import]:
    """Import and re-export statements at the top of the file; a namespace import or ``export *`` names no declaration."""
    out = []
    for s in _STATEMENT.finditer(clean) if "from" in clean else ():
        m = _CLAUSE[s[1]].match(clean, s.end())
        if depth[s.start()] or not m:
            continue
        spec = source[m.end() : source.find(m["q"], m.end())]
        what, paths = m["what"], module_paths(path, spec, aliases)
        listed = re.search(r"\{([^{}]*)\}", what)
        names = _names(listed[1]) if listed else []
        if s[1] == "export":
            out += [Import(spec, n, local, "reexport", paths) for n, local in names]
            continue
        head = re.sub(r"\{[^{}]*\}|\*\s*as\s+[\w$]+", "", what).strip(" ,\t\r\n")
        if head:
            out.append(Import(spec, "default", head, "default", paths))
        out += [Import(spec, n, local, "default" if n == "default" else "named", paths) for n, local in names]
    local = {i.local_name: i for i in out if i.form == "named"}
    for m in _BARE.finditer(clean) if local else ():
        if not depth[m.start()]:
            out += [Import(local[n].specifier, local[n].imported_name, as_, "reexport", local[n].paths) for n, as_ in _names(m[1]) if n in local]
    return out


def _stop(clean: str, at: int, hi: int) -> int:
    """Where a statement without a body ends: at a semicolon, or at a line break after which nothing goes on."""
    i = at
    while i < hi:
        c = clean[i]
        if c in "([{":
            j = B.close_of(clean, i)
            i = j if 0 <= j < hi else i
        elif c == ";":
            return i
        elif c == "\n":
            before, after = clean[at:i].rstrip()[-1:], clean[i:hi].lstrip()[:2]
            if before and before not in "=,(|&?:+-*/<.>" or before == ">" and not clean[at:i].rstrip().endswith("=>"):
                if not after or after[0] not in ")]}.|&?:=+-*/,<>(" or after in ("//", "/*"):
                    return i
        elif c == "}":
            return i
        i += 1
    return hi


def _without_generics(clean: str, at: int) -> str:
    """The text with the commas of type arguments from ``at`` on as spaces."""
    head, rest = clean[:at], clean[at:]
    if "<" not in rest:
        return clean
    rest = re.sub(r"(?<==)(\s*(?:async\s*)?)<([^<>()]*(?:<[^<>()]*>[^<>()]*)*)>(?=\s*\()", lambda m: f"{m[1]} {m[2].replace(',', ' ')} ", rest)
    for _ in range(3):  # innermost first
        rest = re.sub(r"(?<=[\w$])<([^<>;=]*)>", lambda m: f" {m[1].replace(',', ' ')} ", rest)
    return head + rest


def _bound(clean: str, lo: int, hi: int) -> list[str]:
    """The names that a pattern binds: what stands before a default and after a key."""
    out = []
    for a, b in B.split_top(clean, lo, hi):
        part = clean[a:b].split("=")[0] if "{" not in clean[a:b] and "[" not in clean[a:b] else clean[a:b]
        part = part.strip().removeprefix("...")
        nested = re.search(r"[\[{]", part)
        if nested:
            at = a + clean[a:b].index(part) + nested.start()
            out += _bound(clean, at + 1, B.close_of(clean, at))
        elif name := re.search(r"([A-Za-z_$][\w$]*)\s*$", part):
            out.append(name[1])
    return out


_ARROW = re.compile(r"\s*(?::(?P<type>[^=]|=>)*?)?=\s*(?:async\s+)?(?:function\b|(?:<[^>]*>\s*)?(?:\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|[A-Za-z_$][\w$]*)\s*(?::[^={;]+)?=>)", re.S)


_NAME, _TYPED = re.compile(r"[A-Za-z_$][\w$]*"), re.compile(r"\s*:(?P<t>(?:[^=]|=>)*)")


def extract(path: str, source: str, aliases: dict[str, str] | None = None, wanted: tuple[str, ...] = PARTS) -> Extracted:
    clean = B.blank(source)
    depth = B.Depths(clean)
    out = Extracted(fingerprint=digest(source), imports=_imports(path, source, clean, depth, aliases) if "imports" in wanted else [], parse_errors=B.unmatched(clean))
    if "symbols" in wanted or "names" in wanted:
        out.symbols = _symbols(path, source, clean, depth, "symbols" not in wanted)
    quoted = lambda m: clean[m.start()] != " "  # noqa: E731  not in a comment or string
    out.flows = sorted({("route-literal", m[2].split("?")[0]) for m in _FETCH.finditer(source) if quoted(m) and "${" not in m[2].split("?")[0]}) if "fetch(" in source else []
    out.flows += sorted({("table-ref", m[3]) for m in _TABLE.finditer(source) if clean[m.end() - 1] == ")" and not (m[1] or "x")[0].isupper()}) if ".from(" in source else []
    out.flows += sorted({("component", m[1]) for m in _TAG.finditer(source) if quoted(m)}) if path.endswith("x") and "<" in clean else []
    return out


def _symbols(path: str, source: str, clean: str, depth: B.Depths, names: bool = False) -> list[Symbol]:
    """Declarations at the top of the file, with the members of classes; ``names``: see ``model.PARTS``."""
    lines, made = None if names else B.Lines(source), []
    shown = {n for m in _BARE.finditer(clean) if not depth[m.start()] for n, _ in _names(m[1])} if "export" in clean else ()

    def add(name: str, kind: str, raw: str, lo: int, hi: int, signature: str, start: int, exported: bool) -> Symbol:
        text = source[lo:hi].rstrip()
        if names:
            made.append(s := Symbol(f"{path}::{name}", path, kind, raw, 0, 0, "", text, is_exported=exported or name in shown, parent=path))
            return s
        s = Symbol(f"{path}::{name}", path, kind, raw, lines.of(lo), lines.of(max(lo, lo + len(text) - 1)), signature, text, B.doc_before(source, start, ("//",)), exported or name in shown, parent=path)
        made.append(s)
        return s

    for m in _DECL.finditer(clean):
        start, what = m.start("head"), m["what"]
        if depth[start]:
            continue
        exported = bool(m["export"])
        if what == "const":
            end = _stop(clean, m.start("name"), len(clean))
            for a, b in B.split_top(_without_generics(clean[:end], m.start("name")), m.start("name"), end):
                a += len(clean[a:b]) - len(clean[a:b].lstrip())
                if clean[a : a + 1] in "{[":
                    close = B.close_of(clean, a)
                    for n in _bound(clean, a + 1, close):
                        add(n, "value", "const", a, b, f"const {n}", start, exported)
                elif n := _NAME.match(clean, a):
                    arrow = _ARROW.match(clean, n.end(), b)
                    head = arrow.end() if arrow and clean[: arrow.end()].endswith("=>") else clean.find("{", n.end(), b) if arrow else b
                    typed = None if names else _TYPED.match(clean, n.end(), b)
                    signature = "" if names else f"const {B.one_line(source[a:head]).removesuffix('=>').rstrip()}" if arrow else f"const {n[0]}" + (f": {B.one_line(source[typed.start('t') : typed.end('t')])}" if typed else "")
                    add(n[0], "callable" if arrow else "value", "function" if arrow else "const", a, b, signature, start, exported)
            continue
        if m["name"] in "{[" or m["default"] and m["name"] in ("extends", "implements"):
            continue  # an unnamed default declares nothing
        if what == "type":
            end = _stop(clean, m.end(), len(clean))
            add(m["name"], "value", "type", start, end, B.one_line(source[start:end]), start, exported)
            continue
        brace = _brace(clean, m.end())
        if brace < 0:  # an overload, or a declaration without a body
            end = _stop(clean, m.end(), len(clean))
            if what.startswith("function"):
                add(m["name"], "callable", "function", start, end, B.one_line(source[start:end]), start, exported)
            continue
        close = B.close_of(clean, brace)
        end = close + 1 if close >= 0 else len(clean)
        if what.startswith("function"):
            add(m["name"], "callable", "function", start, end, B.one_line(source[start:brace]), start, exported)
        elif what == "class":
            s = add(m["name"], "container", "class", start, end, B.one_line(source[start:brace]), start, exported)
            s.members = _members(path, m["name"], source, clean, brace + 1, end - 1, lines, s.is_exported)
        else:
            add(m["name"], "value", what, start, end, B.one_line(source[start:end]), start, exported)
    return fold_same_id(made)


def _brace(clean: str, at: int) -> int:
    """The brace that opens a body: past parameters and types; -1 if the statement ends before."""
    i = at
    while i < len(clean):
        c = clean[i]
        if c in "([":
            j = B.close_of(clean, i)
            i = j if j >= 0 else i
        elif c == "{":
            before = clean[at:i].rstrip()
            if not before.endswith((":", "|", "&", "<", ",")):
                return i
            j = B.close_of(clean, i)  # an object type
            i = j if j >= 0 else i
        elif c == ";" or c == "}":
            return -1
        elif c == "\n" and re.match(r"\s*(?:export|import|function|class|const|let|var|type|interface|enum|async|declare|abstract|$)\b", clean[i : i + 40]):
            return -1
        i += 1
    return -1


def _members(path: str, owner: str, source: str, clean: str, lo: int, hi: int, lines: B.Lines | None, exported: bool) -> list[Symbol]:
    found = []
    for item in B.items(clean, lo, hi, ";\n"):
        m = _MEMBER.match(clean[item.start : item.head_end])
        if not m or m["name"] in ("if", "for", "return"):
            continue
        text = source[item.start : item.end].rstrip().rstrip(";")
        call = "(" in m["rest"] or "<" in m["rest"]
        public = "private" not in m["mods"] and "protected" not in m["mods"] and not m["name"].startswith("#")
        if lines is None:
            found.append(Symbol(f"{path}::{owner}.{m['name']}", path, "callable" if call else "value", "method" if call else "field", 0, 0, "", text, None, exported and public, public, parent=f"{path}::{owner}"))
            continue
        signature = B.one_line(source[item.start : item.head_end]).rstrip(" ;")
        if not call:
            signature = re.split(r"\s*=(?!>)", signature)[0]
        found.append(Symbol(f"{path}::{owner}.{m['name']}", path, "callable" if call else "value", "method" if call else "field", lines.of(item.start), lines.of(max(item.start, item.end - 1)), signature, text, B.doc_before(source, item.start, ("//",)), exported and public, public, parent=f"{path}::{owner}"))
    number_repeats(found)
    return found
