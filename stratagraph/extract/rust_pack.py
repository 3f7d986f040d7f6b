"""Rust files: items, impl folding, use paths, fingerprint."""

from __future__ import annotations

import posixpath
import re

from stratagraph.extract import braces as B
from stratagraph.extract.model import Extracted, Import, Symbol, digest, number_repeats, rows

_ITEM = re.compile(r"^(?:#!?\[[^\]]*\]\s*)*(?P<vis>pub(?:\([^)]*\))?\s+)?(?:default\s+|const\s+(?=fn|unsafe|async)|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*(?P<what>fn|struct|enum|union|trait|mod|const|static|type|impl|macro_rules!|use)(?:\b|(?<=!))\s*(?:mut\s+)?(?P<name>[A-Za-z_]\w*)?")
_IMPL = re.compile(r"impl\s*(?:<[^{]*?>\s*)?(?:(?P<trait>[\w:]+(?:<[^{]*?>)?)\s+for\s+)?(?P<type>[\w:]+)")
_NUMBER, _STRING = re.compile(r"\b\d[\d_]*(?:\.\d+)?\b"), re.compile(r'"((?:[^"\\]|\\.){8,})"')
_KIND = {"fn": "callable", "macro_rules!": "callable", "struct": "container", "enum": "container", "union": "container", "trait": "container", "mod": "container", "const": "value", "static": "value", "type": "value"}
_ATTRIBUTE = re.compile(r"#\[((?:[^\[\]]|\[[^\]]*\])*)\]")


def module_paths(path: str, parts: list[str], library: dict[str, str] | None = None) -> list[str]:
    """Files that a use path may name; the last part may be an item of the module before it."""
    folder = posixpath.dirname(path)
    stem = posixpath.basename(path)[:-3]
    own = folder if stem in ("mod", "lib", "main") else posixpath.join(folder, stem)
    root = path[: path.index("src/") + 3] if "src/" in path else folder
    if parts[0] == "crate":
        base, rest = root, parts[1:]
    elif parts[0] == "self":
        base, rest = own, parts[1:]
    elif parts[0] == "super":
        ups = len(parts) - len([p for p in parts if p != "super"])
        base, rest = own, parts[ups:]
        for _ in range(ups):
            base = posixpath.dirname(base)
    elif library and parts[0] in library:
        base, rest = library[parts[0]], parts[1:]
    else:
        base, rest = own, parts
    out = []
    for cut in (rest[:-1], rest):
        at = posixpath.join(base, *cut) if cut else base
        out += [f"{at}.rs", f"{at}/mod.rs"] if cut else [f"{at}/lib.rs", f"{at}/main.rs", f"{at}/mod.rs", f"{at}.rs"]
    return list(dict.fromkeys(out))


def _uses(tree: str) -> list[tuple[list[str], str]]:
    """A use tree as (path, local name) pairs."""
    tree = tree.strip()
    if m := re.match(r"^(.*?)(?:::)?\{(.*)\}$", tree, re.S):
        parts, depth, start = [], 0, 0
        for i, c in enumerate(m[2] + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(m[2][start:i])
                start = i + 1
        return [u for p in parts if p.strip() for u in _uses(f"{m[1]}::{p.strip()}" if m[1] else p)]
    path, _, local = (x.strip() for x in tree.partition(" as "))
    names = [p for p in path.split("::") if p]
    if names and names[-1] == "self":
        names.pop()
    return [(names, local or names[-1])] if names and names[-1] != "*" else []


def strip_tests(source: str, clean: str | None = None) -> str:
    """The text without its ``#[cfg(test)]`` modules; ``clean``: the text with comments and strings blank."""
    clean, out, at = B.blank(source, '"\'', nested=True, lifetimes=True) if clean is None else clean, [], 0
    for m in re.finditer(r"#\[cfg\(test\)\]\s*(?:pub\s+)?mod\s+\w+\s*\{", clean):
        if m.start() >= at:
            end = B.close_of(clean, m.end() - 1)
            out.append(source[at : m.start()])
            at = end + 1 if end >= 0 else len(source)
    return "".join([*out, source[at:]])


def extract(path: str, source: str, library: dict[str, str] | None = None) -> Extracted:
    out = Extracted()
    clean = B.blank(source, '"\'', nested=True, lifetimes=True)
    out.parse_errors = B.unmatched(clean)
    lines = B.Lines(source)
    out.symbols = _items(path, path, source, clean, 0, len(clean), lines, out)
    for i in out.imports:  # names of the repository's own libraries lead to their folders
        if library and i.specifier.split("::")[0] in library:
            i.paths = module_paths(path, [*i.specifier.split("::"), i.imported_name], library)
    seen = {(tuple(i.paths), i.imported_name) for i in out.imports}
    for m in re.finditer(r"\bcrate(?:::\w+)+", re.sub(r"(?m)^\s*(pub\s+)?use\s[^;]*;", lambda x: " " * len(x[0]), clean)):
        parts = m[0].split("::")
        i = Import("::".join(parts[:-1]), parts[-1], parts[-1], "qualified", module_paths(path, parts))
        if (tuple(i.paths), i.imported_name) not in seen:
            out.imports.append(i)
            seen.add((tuple(i.paths), i.imported_name))
    kept = B.blank(strip_tests(source, clean), "", nested=True)
    shape = [f"{r['id']} {r['signature']} {r['docstring']} {r['markers']} {r['source_hash'] if r['kind'] == 'value' else ''}" for r in rows(out.symbols)]
    literals = sorted([n for n in _NUMBER.findall(kept) if n not in ("0", "1", "2")] + _STRING.findall(kept))
    head = "\n".join(x for x in source.split("\n") if x.startswith("//!"))
    out.fingerprint = digest("\n".join([*shape, *(f"{i.specifier}::{i.imported_name}" for i in out.imports), head, *literals]))
    return out


def _items(path: str, parent: str, source: str, clean: str, lo: int, hi: int, lines: B.Lines, out: Extracted) -> list[Symbol]:
    found, impls = [], []
    for item in B.items(clean, lo, hi):
        head = clean[item.start : item.head_end]
        m = _ITEM.match(head)
        if not m:
            continue
        text = source[item.start : item.end].rstrip()
        markers = [a.strip() for a in _ATTRIBUTE.findall(source[item.start : item.start + m.start("what")])]
        signature = B.one_line(re.sub(r"^(\s*#!?\[[^\]]*\])+", "", source[item.start : item.head_end])).rstrip(" ;")
        what = m["what"]
        if what == "use":
            tree = re.sub(r"^.*?\buse\b", "", source[item.start : item.end].rstrip(" ;\n"), count=1, flags=re.S).rstrip(";")
            for parts, local in _uses(tree):
                out.imports.append(Import("::".join(parts[:-1]), parts[-1], local, "reexport" if m["vis"] else "named", module_paths(path, parts)))
            continue
        if what == "mod" and any("cfg(test)" in a for a in markers):
            continue
        if what != "impl" and not m["name"]:
            continue
        common = {"file": path, "start_line": lines.of(item.start), "end_line": lines.of(max(item.start, item.end - 1)), "source": text, "docstring": B.doc_before(source, item.start, ("///",)), "markers": markers, "parent": parent}
        public = bool(m["vis"]) or what == "impl"
        if what == "impl":
            i = _IMPL.match(head[m.start("what") :])
            if not i:
                continue
            name = i["type"].rpartition("::")[2]
            trait = (i["trait"] or "").split("<")[0].rpartition("::")[2]
            s = Symbol(f"{parent}::{name} as {trait}" if trait else f"{parent}::{name}", kind="container", raw=f"impl {trait}".strip(), signature=signature, is_exported=True, public=True, **common)
            s.members = _items(path, s.id, source, clean, *item.body, lines, out) if item.body else []
            if trait:
                for x in s.members:
                    x.public = x.is_exported = True
            impls.append((name, trait, s))
            continue
        s = Symbol(f"{parent}::{m['name']}", kind=_KIND[what], raw=what, signature=signature if _KIND[what] != "value" else B.one_line(text).rstrip(";"), is_exported=public, public=public, **common)
        if item.body and what in ("struct", "union", "enum"):
            for k, f in enumerate(B.items(clean, *item.body, ",")):
                own = source[f.start : f.head_end if what != "enum" or not f.body else f.end].strip().rstrip(",")
                n = re.match(r"(?:#\[[^\]]*\]\s*)*(pub(?:\([^)]*\))?\s+)?(\w+)", own)
                if n:
                    vis = bool(n[1]) or what == "enum"
                    s.members.append(Symbol(f"{s.id}::{n[2]}", path, "value", "variant" if what == "enum" else "field", lines.of(f.start), lines.of(f.end), B.one_line(own), own, None, public and vis, vis, parent=s.id))
        elif item.body and what in ("trait", "mod"):
            s.members = _items(path, s.id, source, clean, *item.body, lines, out)
            if what == "trait":
                for x in s.members:
                    x.public = x.is_exported = public
        found.append(s)
    by_name = {s.id.rpartition("::")[2]: s for s in found if s.raw in ("struct", "enum", "union", "trait", "type")}
    traits: dict[str, list[Symbol]] = {}
    inherent = {n for n, t, _ in impls if not t}
    for name, trait, s in impls:
        owner = by_name.get(name)
        if owner is not None and not trait:  # an inherent impl is part of its type
            _fold(owner, s)
        elif owner is not None:
            traits.setdefault(name, []).append(s)
        else:
            found.append(s)
    for name, own in traits.items():
        owner = by_name[name]
        if len(own) == 1 and not owner.members and name not in inherent:  # a plain type with one trait impl
            _fold(owner, own[0])
        else:
            found += own
            out.flows += [("trait-impl", owner.id) for _ in own]
    number_repeats(found)
    return found


def _fold(owner: Symbol, impl: Symbol) -> None:
    for m in impl.members:
        m.id, m.parent = f"{owner.id}::{m.id.rpartition('::')[2]}", owner.id
    owner.kind = "container"
    owner.members += impl.members
    owner.markers += [m for m in impl.markers if m not in owner.markers]
    number_repeats(owner.members)
