"""Tables of SQL DDL: a scanner for ``CREATE TABLE`` statements, and a header pattern for those it can't read."""

from __future__ import annotations

import re

#: The head of a statement; group 3 is the table's name.
HEADER = r'(?i)^\s*create\s+table\s+(if\s+not\s+exists\s+)?("?[a-z_][a-z0-9_]*"?\.)?"?([a-z_][a-z0-9_]*)'
_STATEMENT = re.compile(r'create\s+table\s+(?:if\s+not\s+exists\s+)?(?:"?\w+"?\s*\.\s*)?"?(\w+)"?\s*\(', re.I)
_CONSTRAINT = re.compile(r"(constraint|primary|foreign|unique|check|exclude|like)\b", re.I)


def blank(source: str) -> str:
    """Comments and string literals as spaces of the same length."""
    spaces = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'", spaces, source, flags=re.S)


def tables(source: str) -> list[tuple[str, list[str], int, int]]:
    """(name, columns, first line, last line) of every table; no columns where the list isn't closed."""
    clean, out = blank(source), []
    for m in _STATEMENT.finditer(clean):
        depth, at, parts, start = 1, m.end(), [], m.end()
        while at < len(clean) and depth:
            c = clean[at]
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or not depth:
                parts.append(clean[start:at])
                start = at + 1
            at += 1
        columns = [] if depth else [p.split()[0].strip('"`') for p in parts if p.strip() and not _CONSTRAINT.match(p.strip())]
        line = clean.count("\n", 0, m.start()) + 1
        out.append((m[1], columns, line, line + clean.count("\n", m.start(), at if not depth else m.end())))
    return out
