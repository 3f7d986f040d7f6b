"""Java files: types, members, annotations and imports."""

from __future__ import annotations

import re

from stratagraph.extract import braces as B
from stratagraph.extract.model import Extracted, Import, Symbol, digest, number_repeats

_ANNOTATION = re.compile(r"@(?!interface\b)[\w.]+\s*(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?")
_TYPE = re.compile(r"\b(class|interface|enum|record|@interface)\s+(\w+)")
_IMPORT = re.compile(r"(?m)^\s*import\s+(static\s+)?([\w.]+?)(?:\.(\*))?\s*;")
_PACKAGE = re.compile(r"(?m)^\s*package\s+([\w.]+)\s*;")
_ENTITY = re.compile(r"^@Entity\b")
_HIDDEN, _PUBLIC, _PANACHE = re.compile(r"\b(private|protected)\b"), re.compile(r"\bpublic\b"), re.compile(r"\bextends\s+PanacheEntity")
_CALL, _WORD = re.compile(r"(\w+)\s*\("), re.compile(r"\b[A-Z]\w*\b")
_DECLARED, _SPACES = re.compile(r"(\w+)\s*(?:\[\s*\]\s*)*$"), re.compile(r"\s+")


def module_paths(name: str, static: bool) -> list[str]:
    parts = name.split(".")
    out = ["*/" + "/".join(parts) + ".java"] if not static else []
    for k in range(len(parts) - 1, 0, -1):  # members and nested types
        out.append("*/" + "/".join(parts[:k]) + ".java")
    return out


def extract(path: str, source: str) -> Extracted:
    out = Extracted(fingerprint=digest(source))
    clean = B.blank(source, "\"'")
    out.parse_errors = B.unmatched(clean)
    lines = B.Lines(source)
    for m in _IMPORT.finditer(clean):
        name = m[2]
        if m[3]:
            out.imports.append(Import(name, "*", None, "star", []))
        else:
            owner, _, last = name.rpartition(".")
            out.imports.append(Import(owner, last, last, "named", module_paths(name, bool(m[1]))))
    out.symbols = _types(path, path, source, clean, 0, len(clean), lines, True)
    own = "/".join(path.split("/")[:-1])
    shown = {i.local_name for i in out.imports}
    words = sorted(set(_WORD.findall(clean)) - shown - {s.id.rpartition("::")[2] for s in out.symbols})
    out.imports += [Import(".", w, w, "qualified", [f"{own}/{w}.java".lstrip("/")]) for w in words]  # the same package's types
    out.words = words
    return out


def _types(path: str, parent: str, source: str, clean: str, lo: int, hi: int, lines: B.Lines, exported: bool) -> list[Symbol]:
    found = []
    for item in B.items(clean, lo, hi):
        head = source[item.start : item.head_end]
        bare_clean = clean[item.start : item.head_end]
        if "@" in bare_clean:
            bare_clean = _ANNOTATION.sub(lambda m: " " * len(m[0]), bare_clean)
        markers = [B.one_line(m[0]) for m in _ANNOTATION.finditer(head)] if "@" in head else []
        bare = B.one_line(_ANNOTATION.sub(" ", head)) if markers else B.one_line(head)
        text, at = source[item.start : item.end].rstrip(), item.start
        if item.body and bare_clean.strip() in ("", "static"):
            continue  # an initialiser block declares nothing
        common = {"file": path, "start_line": lines.of(at), "end_line": lines.of(max(at, item.end - 1)), "source": text, "docstring": B.doc_before(source, at, ("///",)), "markers": markers, "parent": parent}
        public = not _HIDDEN.search(bare_clean)
        t = _TYPE.search(bare_clean)
        if t and item.body and "=" not in bare_clean:
            shown = exported and bool(_PUBLIC.search(bare_clean))
            s = Symbol(f"{parent}::{t[2]}", kind="container", raw=t[1], signature=bare, is_exported=shown, public=public, **common)
            body = item.body
            if t[1] == "enum":
                stop = clean.find(";", *body)
                depth = [i for i in range(body[0], body[1]) if clean[i] == ";" and clean.count("{", body[0], i) == clean.count("}", body[0], i)]
                stop = depth[0] if depth else body[1]
                s.members = [Symbol(f"{s.id}::{n}", path, "value", "enum_constant", lines.of(at), lines.of(at), n, n, None, shown, True, parent=s.id) for n in re.findall(r"(?:^|,)\s*(?:@\w+\s+)*([A-Z_]\w*)", re.sub(r"\([^()]*\)|\{[^{}]*\}", "", clean[body[0] : stop]))]
                body = (min(stop + 1, body[1]), body[1])
            s.members += _types(path, s.id, source, clean, *body, lines, shown)
            number_repeats(s.members)
            if any(_ENTITY.match(m) for m in markers) or _PANACHE.search(bare_clean):
                s.kind = "schema"
            found.append(s)
        elif parent != path and item.body and bare_clean.split()[-1:] == [parent.rpartition("::")[2]] and "=" not in bare_clean:
            found.append(Symbol(f"{parent}::<init>", kind="callable", raw="constructor", signature=bare, is_exported=exported and public, public=public, **common))  # a record's short form
        elif parent != path and (call := _CALL.search(bare_clean)) and "=" not in bare_clean[: call.start()]:
            name = "<init>" if call[1] == parent.rpartition("::")[2] else call[1]
            found.append(Symbol(f"{parent}::{name}", kind="callable", raw="constructor" if name == "<init>" else "method", signature=bare, is_exported=exported and public, public=public, **common))
        elif parent != path:
            whole = source[item.start : item.end]
            signature = B.one_line(_ANNOTATION.sub(" ", whole) if "@" in whole else whole).rstrip("; ")
            for name in _declarators(bare_clean):
                found.append(Symbol(f"{parent}::{name}", kind="value", raw="field", signature=signature, is_exported=exported and public, public=public, **common))
    return found


def _declarators(head: str) -> list[str]:
    """The names that a field declaration binds: ``int a, b[] = {}, c = f(x)`` binds a, b and c."""
    out = []
    for k, (a, b) in enumerate(B.split_top(head, 0, len(head), angles=True)):
        own = head[a:b].split("=")[0].strip()
        m = _DECLARED.search(own)
        if not m or not k and not _SPACES.search(own):
            break
        out.append(m[1])
    return out
