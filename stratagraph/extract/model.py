"""What a pack extracts from one file, and the rules that all packs share."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field


#: What of a file may be left empty where nothing reads it. Where only the ``names`` of symbols are wanted, they have
#: their id, kind and place among the others, but no lines, signature, docstring, markers, hashes or size; where
#: their ``places`` are, lines and markers too.
PARTS = ("text", "symbols", "imports", "flows", "words")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@dataclass
class Symbol:
    id: str
    file: str
    kind: str  # container, callable, value or schema
    raw: str
    start_line: int
    end_line: int
    signature: str
    source: str
    docstring: str | None = None
    is_exported: bool = False
    public: bool = True
    markers: list[str] = field(default_factory=list)
    parent: str | None = None
    members: list[Symbol] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)  # sources of further declarations that folded in

    @property
    def source_hash(self) -> str:
        """Of the source; a container's from its signature and its members' hashes, in order."""
        if self.kind in ("container", "schema") and self.members:
            return digest("\n".join([self.signature, *(m.source_hash for m in self.members)]))
        return digest("\n".join([self.source, *self.parts]) if self.parts else self.source)

    @property
    def interface_hash(self) -> str | None:
        """What others can see: the signature, and a container's public members' signatures; null if not exported."""
        if not self.is_exported:
            return None
        return digest("\n".join([self.signature, *(m.signature for m in self.members if m.public)]))


@dataclass
class Import:
    """``paths``: where the target may be, best first; an entry that starts with ``*/`` is a path suffix."""

    specifier: str
    imported_name: str | None
    local_name: str | None
    form: str  # named, default, module, reexport, star, include or qualified
    paths: list[str] = field(default_factory=list)


@dataclass
class Extracted:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    flows: list[tuple[str, str]] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    parse_errors: int | None = 0
    fingerprint: str = ""


def number_repeats(members: list[Symbol]) -> None:
    """The second of equal ids becomes ``#2`` and so on, past names that are taken."""
    taken: set[str] = set()
    for m in members:
        name, n = m.id, 1
        while m.id in taken:
            n += 1
            m.id = f"{name}#{n}"
        taken.add(m.id)


def fold_same_id(symbols: list[Symbol]) -> list[Symbol]:
    """Declarations of one id become one symbol: a body wins, the first docstring stays, export is either's."""
    by_id: dict[str, Symbol] = {}
    for s in symbols:
        first = by_id.get(s.id)
        if first is None:
            by_id[s.id] = s
            continue
        keep, other = (s, first) if (s.kind == "container", "{" in s.source) > (first.kind == "container", "{" in first.source) else (first, s)
        keep.parts = sorted([*keep.parts, other.source, *other.parts])
        keep.docstring = first.docstring or s.docstring
        keep.is_exported = first.is_exported or s.is_exported
        keep.members = keep.members or other.members
        by_id[s.id] = keep
    return list(by_id.values())


NAMES = ("id", "file", "kind", "raw", "parent", "is_exported", "public")
PLACES = (*NAMES, "start_line", "end_line", "markers")


def rows(symbols: list[Symbol], names: tuple[str, ...] = ()) -> list[dict]:
    """Symbols and their members as flat rows in source order; ``names``: only these of what they have, and their place."""
    out: list[dict] = []

    def add(s: Symbol, top: bool) -> None:
        if names:
            out.append({k: getattr(s, k) for k in names} | {"ord": len(out), "is_top_level": top})
            for m in s.members:
                add(m, False)
            return
        row = {k: v for k, v in vars(s).items() if k not in ("members", "parts", "source")}
        out.append(row | {"ord": len(out), "source_hash": s.source_hash, "interface_hash": s.interface_hash, "is_top_level": top, "bytes": len(s.source.encode())})
        for m in s.members:
            add(m, False)

    for s in symbols:
        add(s, True)
    return out
