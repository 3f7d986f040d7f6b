"""The packs by name, and one entry point that reads any file its path routes to a pack."""

from __future__ import annotations

from collections.abc import Callable

from stratagraph.extract import cpp_pack, java_pack, python_pack, rust_pack, sql_pack, ts_pack
from stratagraph.extract.model import PARTS, Extracted, Symbol, digest


def _schema(path: str, source: str) -> Extracted:
    lines = source.split("\n")
    made = [
        Symbol(f"{path}::{name}", path, "schema", "create_table", a, b, f"{name}({', '.join(columns)})", "\n".join(lines[a - 1 : b]), None, True, parent=path)
        for name, columns, a, b in sql_pack.tables(source)
    ]
    return Extracted(symbols=list({s.id: s for s in made}.values()), fingerprint=digest(source))


PACKS: dict[str, Callable[..., Extracted]] = {
    "python": python_pack.extract,
    "typescript": ts_pack.extract,
    "rust": rust_pack.extract,
    "java": java_pack.extract,
    "cpp": cpp_pack.extract,
}


def for_name(pack: str) -> Callable[..., Extracted]:
    if pack not in PACKS:
        raise ValueError(f"no pack is named {pack}; there are {', '.join(PACKS)}")
    return PACKS[pack]


def extract(pack: str, kind: str, path: str, source: str, known: dict[str, str] | None = None, wanted: tuple[str, ...] = PARTS) -> Extracted:
    """``known``: import aliases of a TypeScript repository, library folders of a Rust one.

    Where the symbols are not ``wanted``, packs whose other parts need none do not make them.
    """
    if "places" in wanted and pack != "cpp":
        wanted = (*wanted, "symbols")
    if kind == "schema":
        return _schema(path, source)
    if pack == "typescript":
        return ts_pack.extract(path, source, known, wanted)
    if pack == "python":
        return python_pack.extract(path, source, wanted)
    if pack == "cpp":
        return cpp_pack.extract(path, source, wanted)
    return PACKS[pack](path, source, known) if known and pack == "rust" else for_name(pack)(path, source)
