"""C++ files: types, functions, prototypes, aliases, macros, includes and words."""

from __future__ import annotations

import posixpath
import re

from stratagraph.extract import braces as B
from stratagraph.extract import cpp_macros as M
from stratagraph.extract.model import PARTS, Extracted, Import, Symbol, digest, fold_same_id
from stratagraph.functions.paths import CPP_HEADERS

_INCLUDE = re.compile(r'(?m)^[ \t]*#[ \t]*include[ \t]*([<"])([^>"\n]+)[>"]')
_MACRO = re.compile(r"(?m)^[ \t]*#[ \t]*define[ \t]+(\w+)(\([^)]*\))?")
_DIRECTIVE = re.compile(r"(?m)^[ \t]*#(?:[^\n]*\\\n)*[^\n]*")
_CONDITION = re.compile(r"(?m)^[ \t]*#[ \t]*(if\w*|elif\w*|else|endif)\b(?:[^\n]*\\\n)*[^\n]*")
_NAMESPACE = re.compile(r"(?:(inline)\s+)?namespace\s*((?:[\w]|::|\binline\s)*)\s*$")
_TYPE = re.compile(r"\b(class|struct|union|enum(?:\s+class|\s+struct)?)\b\s*((?:[A-Za-z_]\w*\s*::\s*)*[A-Za-z_]\w*)?(?:\s+final)?\s*(?::(?!:).*)?$", re.S)
_FUNCTION = re.compile(r"((?:[A-Za-z_]\w*\s*::\s*)*(?:~\s*[A-Za-z_]\w*|operator\s*(?:\(\s*\)|\[\s*\]|[^\s(\w]+|(?:new|delete|co_await)(?:\s*\[\s*\])?|\"\s*\"\s*\w+|[\w:\s*&]+)|[A-Za-z_]\w*))\s*(?=\()")
_KEYWORDS = {"if", "for", "while", "switch", "return", "catch", "sizeof", "decltype", "alignas", "static_assert", "defined", "noexcept", "explicit", "throw", "requires", "void", "int", "char", "bool", "float", "double", "long", "short", "unsigned", "signed", "auto", "const"}
_NOT_VARIABLE = re.compile(r"^(?:class|struct|union|enum|friend|using|typedef|namespace|return|goto|delete|throw|template|static_assert|public|private|protected|case|default|module|import|export)\b")
_ACCESS = re.compile(r"\s*(public|private|protected)\s*:(?!:)")
_STATIC = re.compile(r"(?:inline\s+|constexpr\s+)*static\b")
_LINKAGE = re.compile(r'extern\s*(" *")?\s*$')
_NAMED_AFTER = re.compile(r"\s*([A-Za-z_]\w*)\s*;")
_FIRST_NAME = re.compile(r"\s*([A-Za-z_]\w*)")
_NO_DECLARATION = re.compile(r"using\s+(?:namespace\b|enum\b|typename\b|[\w:\s]+$)|friend\b")
_ALIAS = re.compile(r"using\s+([A-Za-z_]\w*)\s*=|concept\s+(\w+)\s*=")
_TYPEDEF_NAME = re.compile(r"\(\s*\*\s*(\w+)\s*\)|([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)*$")
_DEFAULTED = re.compile(r"=\s*(default|delete)\b")
_TEMPLATE = re.compile(r"\btemplate\s*<")
_SPACE = re.compile(r"\s+")
_ASSIGNED = re.compile(r"[^(]*=")
_IN_CALL = re.compile(r"[(,]$")
_MAY_CALL = re.compile(r"(?:explicit|decltype|noexcept)\b")
_POINTER = re.compile(r"([\w:\s*&]+)\(\s*[*&]+\s*([A-Za-z_]\w*)\s*\)")
_VALUE = re.compile(r"[={]")
_EXTENT = re.compile(r"\[[^\]]*\]")
_BITS = re.compile(r"\s*:(?!:)\s*\d+$")
_BITS_NAMED = re.compile(r"(?<!:):(?!:)\s*\w+$")
_VARIABLE = re.compile(r"(?P<type>.*?[\s*&>])?(?P<name>(?:[A-Za-z_]\w*\s*::\s*)*[A-Za-z_]\w*)$", re.S)
_WORD = re.compile(r"[A-Za-z_]\w*")
_TEST = re.compile(r"^\s*(TEST|TEST_F|TEST_P|TYPED_TEST)\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)")


def is_header(path: str) -> bool:
    return path.rpartition(".")[2].lower() in CPP_HEADERS


def include_paths(path: str, spec: str, quoted: bool) -> list[str]:
    beside = [posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))] if quoted else []
    own = [*beside, posixpath.normpath(spec), f"include/{spec}", f"src/{spec}"]
    if quoted or "/" in spec:
        own.append("!/" + spec)  # only if one file ends so
    return list(dict.fromkeys(own))


def extract(path: str, source: str, wanted: tuple[str, ...] = PARTS) -> Extracted:
    """Without symbols, their names or places ``wanted`` the declarations are not read, and ``parse_errors`` is null."""
    out = Extracted(fingerprint=digest(source))
    declared = "symbols" in wanted or "names" in wanted or "places" in wanted
    included = list(_INCLUDE.finditer(source)) if "imports" in wanted else []
    if not declared:
        out.parse_errors = None
    if not (declared or included or "words" in wanted):
        return out
    quiet = B.blank(source, "\"'")
    for m in included:
        if quiet[m.start() : m.end()].strip().startswith("#"):
            out.imports.append(Import(m[2], None, None, "include", include_paths(path, m[2], m[1] == '"')))
    out.imports = list({i.specifier: i for i in out.imports}.values())
    if "words" in wanted:
        out.words = sorted(set(_WORD.findall(quiet)))
    if not declared:
        return out
    clean = quiet
    if "#" in quiet:
        clean = M.blank_branches(quiet, [(m.start(), m.end(), m[1]) for m in _CONDITION.finditer(quiet)])
        clean = _DIRECTIVE.sub(lambda m: M.spaces(m[0]), clean)
    clean = M.blank_macros(M.blank_templates(clean))
    out.parse_errors = B.unmatched(clean)
    lines = B.Lines(source)
    header = is_header(path)
    out.symbols = [Symbol(f"{path}::{m[1]}", path, "callable" if m[2] else "value", "macro", lines.of(m.start()), lines.of(m.end()), B.one_line(m[0]), m[0], None, header, parent=path) for m in _MACRO.finditer(quiet)]
    out.symbols += _items(path, path, "", source, clean, 0, len(clean), lines, header, "", light="symbols" not in wanted)
    # A definition outside its class is part of the member that the class declares.
    members = {m.id: m for s in out.symbols for m in s.members}
    for s in [x for x in out.symbols if x.id in members]:
        members[s.id].parts = sorted([*members[s.id].parts, s.source])
    out.symbols = fold_same_id([s for s in out.symbols if s.id not in members])
    return out


def plain_name(name: str) -> str:
    """A name without template arguments and white space."""
    if "operator" in name:
        return re.sub(r"operator\s+(?=[^\w\s])", "operator", re.sub(r"\s+", " ", name))
    return re.sub(r"\s+", "", without_angles(name))


def without_angles(head: str) -> str:
    """Template arguments as spaces; comparison and shift operators stay."""
    if "operator" in head:
        at = head.index("operator")
        end = re.compile(r"operator\s*(?:\(\s*\)|[^\s\w(]*)").match(head, at).end()
        return without_angles(head[:at]) + head[at:end] + without_angles(head[end:])
    while "<" in head:
        less = re.sub(r"<[^<>]*>", lambda m: " " * len(m[0]), head)
        if less == head:
            break
        head = less
    return head


def _items(path: str, parent: str, chain: str, source: str, clean: str, lo: int, hi: int, lines: B.Lines, header: bool, owner: str, anon: bool = False, access: str = "public", named: str = "", light: bool = False) -> list[Symbol]:
    """Declarations of a region. owner: the kind of class it is the body of; access: how visible that class is.

    light: without docstrings and signatures.
    """
    found, level, templates = [], "private" if owner == "class" else "public", "template" in source
    for item in B.items(clean, lo, hi):
        head = clean[item.start : item.head_end]
        while m := _ACCESS.match(head):
            level, skip = m[1], m.end()
            item.start += skip
            head = head[skip:]
        item.start += len(head) - len(head.lstrip())
        head = without_angles(head.lstrip())
        end = item.end
        at = item.start
        if not head.strip():
            continue
        start = _template_start(source, clean, at, lo) if templates else at
        docs = None if light else B.doc_before(source, at, ("///", "//!", "//")) or (B.doc_before(source, start, ("///", "//!", "//")) if start != at else None)
        common = {"file": path, "start_line": lines.of(start), "end_line": lines.of(max(at, end - 1)), "source": source[start:end].rstrip(), "docstring": docs, "parent": parent}
        signature = "" if light else B.one_line(source[start : item.head_end]).rstrip(" ;")
        static = bool(_STATIC.match(head))
        shown = not owner and (header or not (anon or static))
        public = level != "private" or not owner
        prefix = f"{parent}::" if owner else f"{path}::{chain}"
        mine = {"is_exported": shown, "public": public}

        def leaf(name: str, kind: str, raw: str, sig: str, shown_: bool | None = None, markers: list[str] | None = None) -> None:
            found.append(Symbol(prefix + name, kind=kind, raw=raw, signature=sig, is_exported=shown if shown_ is None else shown_, public=public, markers=markers or [], **common))  # noqa: B023

        if item.body and (n := _NAMESPACE.search(head)):
            parts = [x.strip() for x in n[2].split("::")]
            keep = [x for x in parts if x and not x.startswith("inline ")] if not n[1] else []
            found += _items(path, parent, chain + "".join(x + "::" for x in keep), source, clean, *item.body, lines, header, "", anon or not n[2].strip(), light=light)
        elif item.body and _LINKAGE.match(head):
            found += _items(path, parent, chain, source, clean, *item.body, lines, header, "", anon, light=light)
        elif item.body and (t := _TYPE.search(head)) and "(" not in head[: t.start()]:
            after = _NAMED_AFTER.match(clean, end)
            name = t[2] or (after[1] if after and head.startswith("typedef") else "")
            name = _SPACE.sub("", name)
            kind = t[1].split()[0]
            names = [(a, _FIRST_NAME.match(clean[a:b])) for a, b in B.split_top(clean, *item.body)] if kind == "enum" else []
            if not name:
                if kind == "enum":
                    for a, e in names:
                        if e:
                            line = lines.of(a + e.start(1))
                            found.append(Symbol(prefix + e[1], path, "value", "enumerator", line, line, e[1], e[1], None, shown, public, parent=parent))
                elif owner and not after:  # members of an unnamed struct are the enclosing class's
                    found += _items(path, parent, chain, source, clean, *item.body, lines, header, kind, anon, access, named, light)
                continue
            exported = (header or not anon) if not owner else public and access != "private"
            s = Symbol(prefix + name, kind="container", raw=kind, signature=signature, is_exported=exported, public=public, **common)
            if kind == "enum":
                s.members = [Symbol(f"{s.id}::{e[1]}", path, "value", "enumerator", lines.of(a + e.start(1)), lines.of(a + e.start(1)), e[1], B.one_line(source[a : a + len(e[0])]), None, False, True, parent=s.id) for a, e in names if e]
            else:
                s.members = fold_same_id(_items(path, s.id, chain, source, clean, *item.body, lines, header, kind, anon, level if owner else "public", name.rpartition("::")[2], light))
            found.append(s)
        elif t := _TEST.match(head):
            leaf(f"{t[2]}.{t[3]}", "callable", "test", signature, False)
        elif _NO_DECLARATION.match(head) and "=" not in head:
            continue
        elif a := _ALIAS.match(head):
            leaf(a[1] or a[2], "value", "using" if a[1] else "concept", B.one_line(source[at:end].rstrip()).rstrip(";"), shown and header)
        elif head.startswith("typedef"):
            if a := _TYPEDEF_NAME.search(head):
                leaf(a[1] or a[2], "value", "typedef", B.one_line(source[at:end].rstrip()).rstrip(";"), shown and header)
        elif (f := _function(head, item.body is not None, named)) is not None:
            name = plain_name(f)
            cut = re.split(r"\)\s*:\s*(?!:)", signature)
            raw = ("qualified_" if "::" in name else "") + ("function" if item.body or _DEFAULTED.search(head) else "prototype")
            leaf(name, "callable", raw, cut[0] + (")" if len(cut) > 1 else ""), markers=[f"chain:{chain.count('::')}"] if "::" in name else None)
        elif not _NOT_VARIABLE.match(head):
            for name, typed in _variables(head):
                constant = bool(re.search(r"\b(?:const|constexpr)\b", typed)) and not re.search(r"\bextern\b", typed)
                raw = "field" if owner else "qualified_variable" if "::" in name else "variable"
                leaf(name, "value", raw, re.split(r"\s*=|\s*\{", signature)[0], shown and (header or not constant), [f"chain:{chain.count('::')}"] if raw.startswith("qualified") else None)
    return found


def _template_start(source: str, clean: str, at: int, lo: int) -> int:
    """Where the template head that was blanked before a declaration begins, else the declaration."""
    blank = lo + len(clean[lo:at].rstrip())
    m = _TEMPLATE.search(source, blank, at)
    return m.start() if m and not clean[m.start() : at].strip() else at


def _function(head: str, has_body: bool, owner: str) -> str | None:
    """The name of the function that a head declares."""
    if "(" not in head or "operator" not in head and _ASSIGNED.match(head):
        return None
    for f in _FUNCTION.finditer(head):
        name = _SPACE.sub(" ", f[1]).strip()
        last = _SPACE.sub("", name).rpartition("::")[2]
        if last in _KEYWORDS or name in _KEYWORDS:
            continue
        before = head[: f.start()].strip()
        parts = _SPACE.sub("", name).split("::")
        made = len(parts) > 1 and parts[-1].lstrip("~") == parts[-2] or last.lstrip("~") == owner or last.startswith("operator") or last.startswith("~")
        if not before and not made:
            return None  # a call, not a declaration
        if _IN_CALL.search(before) or "(" in before and not _MAY_CALL.match(before):
            return None
        return name
    return None


def _variables(head: str) -> list[tuple[str, str]]:
    """The names that a declaration without a function introduces, each with the text before it."""
    out, first = [], ""
    if m := "(" in head and _POINTER.match(head):  # a pointer to a function or an array
        return [(m[2], m[1])]
    for k, (a, b) in enumerate(B.split_top(head, 0, len(head))):
        part = _VALUE.split(_EXTENT.sub("", head[a:b]), maxsplit=1)[0].strip()
        part = _BITS.sub("", _BITS_NAMED.sub("", part)).strip() if ":" in part else part
        m = _VARIABLE.match(part)
        if not m or not k and not m["type"]:
            return out
        first = first or m["type"] or ""
        out.append((_SPACE.sub("", m["name"]), first))
    return out
