"""Python files by the standard parser."""

from __future__ import annotations

import ast
import functools
import re
from collections import deque
from collections.abc import Iterator

from stratagraph.extract.model import PARTS, Extracted, Import, Symbol, digest, number_repeats

ROUTE_VERBS = ["get", "post", "put", "patch", "delete", "head", "options", "websocket"]
_ROUTE = re.compile(rf"^[\w.]+\.({'|'.join(ROUTE_VERBS)})\(\s*[rf]?['\"]([^'\"]*)['\"]")
_PRIMITIVES = {"str", "int", "float", "bool", "bytes", "dict", "list", "set", "tuple", "Any", "None", "object", "Request", "Response"}
_TABLE_BASES = {"Base", "DeclarativeBase"}


def route_of(marker: str) -> tuple[str, str] | None:
    m = _ROUTE.match(marker)
    return (m[1], m[2]) if m else None


def _name(node: ast.expr) -> str:
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else ast.unparse(node).rpartition(".")[2]


@functools.cache
def _blocks(node: type) -> tuple[str, ...]:
    return tuple(f for f in node._fields if f in ("body", "handlers", "orelse", "finalbody", "cases"))


def statements(tree: ast.Module) -> Iterator[ast.AST]:
    """Those of ``ast.walk`` in its order, with handlers and cases; no expression is entered, as none holds a statement."""
    todo = deque([tree])
    while todo:
        node = todo.popleft()
        for f in _blocks(type(node)):
            todo.extend(getattr(node, f))
        yield node


class _Reader:
    def __init__(self, path: str, source: str):
        self.path, self.lines, self.shown = path, source.splitlines(), {}

    def unparsed(self, node: ast.expr) -> str:
        """The text of a decorator, which symbols and flows both read, is made once."""
        if isinstance(node, ast.Name):
            return node.id
        if node not in self.shown:
            self.shown[node] = ast.unparse(node)
        return self.shown[node]

    def text(self, node: ast.AST) -> str:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        return "\n".join(self.lines[first - 1 : node.end_lineno])

    def symbol(self, node: ast.stmt, parent: str, parent_exported: bool, top: bool) -> list[Symbol]:
        prefix = f"{parent}::"
        common = {"file": self.path, "start_line": min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]), "end_line": node.end_lineno or node.lineno, "source": self.text(node), "parent": parent}
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
            head = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
            return [self._made(node.name, "callable", type(node).__name__, f"{head} {node.name}({ast.unparse(node.args)}){returns}", node, prefix, common, top, parent_exported)]
        if isinstance(node, ast.ClassDef):
            bases = ", ".join([*map(self.unparsed, node.bases), *(f"{k.arg}={self.unparsed(k.value)}" if k.arg else f"**{self.unparsed(k.value)}" for k in node.keywords)])
            s = self._made(node.name, "container", "ClassDef", f"class {node.name}({bases})" if bases else f"class {node.name}", node, prefix, common, top, parent_exported)
            s.members = [m for child in node.body for m in self.symbol(child, s.id, s.is_exported, False)]
            number_repeats(s.members)
            if any(k.arg == "table" and self.unparsed(k.value) == "True" for k in node.keywords) or any(_name(b) in _TABLE_BASES for b in node.bases):
                s.kind = "schema"
            return [s]
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        names = [n.id for t in targets for n in ([t] if isinstance(t, ast.Name) else t.elts if isinstance(t, ast.Tuple | ast.List) else []) if isinstance(n, ast.Name)]
        signature = common["source"].split("\n")[0].strip()
        return [self._made(n, "value", type(node).__name__, signature, node, prefix, common, top, parent_exported) for n in names]

    def _made(self, name: str, kind: str, raw: str, signature: str, node: ast.stmt, prefix: str, common: dict, top: bool, parent_exported: bool) -> Symbol:
        public = not name.startswith("_") or name == "__init__"
        doc = ast.get_docstring(node) if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef) else None
        markers = [self.unparsed(d) for d in getattr(node, "decorator_list", [])]
        return Symbol(id=prefix + name, kind=kind, raw=raw, signature=signature, docstring=doc, is_exported=public and parent_exported, public=public, markers=markers, **common)


def module_paths(path: str, specifier: str, name: str | None) -> list[str]:
    """Where a module may be: relative to the file, else from the root, else below any folder."""
    dots = len(specifier) - len(specifier.lstrip("."))
    parts = [p for p in specifier[dots:].split(".") if p]
    if dots:
        base = path.split("/")[:-dots] if len(path.split("/")) >= dots else []
        found = ["/".join([*base, *parts])]
    else:
        found = ["/".join(parts), "*/" + "/".join(parts)]
    out = []
    for f in found:
        stem = f.strip("/")
        out += [f"{stem}.py", f"{stem}/__init__.py"] if stem else ["__init__.py"]
        if name and name != "*":
            out += [f"{stem}/{name}.py".lstrip("/"), f"{stem}/{name}/__init__.py".lstrip("/")]
    return out


def extract(path: str, source: str, wanted: tuple[str, ...] = PARTS) -> Extracted:
    out = Extracted(fingerprint=digest(source))
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        out.parse_errors = 1
        return out
    reader = _Reader(path, source)
    if "symbols" in wanted:
        out.symbols = [s for node in tree.body for s in reader.symbol(node, path, True, True)]
        number_repeats(out.symbols)
    for node in statements(tree):
        if isinstance(node, ast.Import):
            out.imports += [Import(a.name, None, a.asname or a.name.split(".")[0], "module", module_paths(path, a.name, None)) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            spec = "." * node.level + (node.module or "")
            form = "reexport" if path.endswith("__init__.py") else "named"
            out.imports += [Import(spec, a.name, a.asname or a.name, "star" if a.name == "*" else form, module_paths(path, spec, a.name)) for a in node.names]
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) and any(route_of(reader.unparsed(d)) for d in node.decorator_list):
            for c in ast.walk(node):
                if isinstance(c, ast.Call) and _name(c.func) == "Depends" and c.args:
                    out.flows.append(("depends", _name(c.args[0])))
            for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]:
                if isinstance(a.annotation, ast.Name) and a.annotation.id not in _PRIMITIVES:
                    out.flows.append(("parameter", a.annotation.id))
    out.flows = sorted(set(out.flows))
    return out
