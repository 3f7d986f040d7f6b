"""A small reader for languages with braces: blanked comments and strings, matched brackets, items of a body."""

from __future__ import annotations

import bisect
import functools
import re
from dataclasses import dataclass

_OPERATOR = re.compile(r"\boperator\s*[-+*/%^&|<>!~]*$")
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_BRACKET = re.compile(r"[()\[\]{}]")


_CHARACTER = re.compile(r"'(\\.[^']*|[^'\\])'")
_RAW = re.compile(r'b?r(#*)"')
_NESTED = re.compile(r"/\*|\*/")
_NOT_NEWLINE = re.compile(r"[^\n]+")


@functools.cache
def _hidden(quotes: str, line: str, lifetimes: bool) -> re.Pattern:
    """Where a comment, a string or, with ``lifetimes``, a raw string may begin."""
    return re.compile("|".join([re.escape(line), r"/\*", *([_RAW.pattern, "'"] if lifetimes else []), *map(re.escape, quotes)]))


@functools.cache
def _quoted(quote: str, lines: bool) -> re.Pattern:
    """What follows an opening quote, up to the closing one or, unless ``lines``, a line break after the first character."""
    step = rf"\\[\s\S]?|[^{re.escape(quote)}\\]"
    return re.compile(f"(?:{step})*" if lines else rf"(?:(?:{step})(?:(?!\n)(?:{step}))*)?")


def blank(source: str, quotes: str = "\"'`", line: str = "//", nested: bool = False, lifetimes: bool = False) -> str:
    """Comments and string contents as spaces, newlines kept, so that positions stay."""
    out, kept, i, n = [], 0, 0, len(source)
    hidden = _hidden(quotes, line, lifetimes)
    while i < n and (found := hidden.search(source, i)):
        i = a = found.start()
        c = source[i]
        if source.startswith(line, i):
            j = source.find("\n", i)
            i = b = n if j < 0 else j
        elif source.startswith("/*", i):
            if nested:
                depth, j = 1, n
                for m in _NESTED.finditer(source, i + 2):
                    depth += 1 if m[0] == "/*" else -1
                    if not depth:
                        j = m.end()
                        break
            else:
                j = source.find("*/", i + 2)
                j = n if j < 0 else j + 2
            i = b = j
        elif lifetimes and (m := _RAW.match(source, i)) and (i == 0 or not source[i - 1].isalnum()):
            j = source.find('"' + m[1], m.end())
            i = n if j < 0 else j + 1 + len(m[1])
            a, b = m.end(), i - 1 - len(m[1])
        elif lifetimes and c == "'" and not _CHARACTER.match(source, i):
            i += 1
            continue
        elif c in quotes:
            a = i + 1
            b = _quoted(c, lifetimes or c == "`").match(source, a).end()
            i = b + 1
        else:
            i += 1
            continue
        if a < b:
            out += source[kept:a], _NOT_NEWLINE.sub(lambda m: " " * len(m[0]), source[a:b])
            kept = b
    return "".join([*out, source[kept:]])


@functools.lru_cache(maxsize=4)
def _closings(clean: str) -> tuple[dict[int, int], bool]:
    """Where each opening bracket is closed, from one pass; those open where a wrong one comes, or at the end, have none.

    And whether every bracket has its partner.
    """
    out, stack, whole = {}, [], True
    for m in _BRACKET.finditer(clean):
        c = m[0]
        if c in _PAIRS:
            stack.append((_PAIRS[c], m.start()))
        elif stack and stack[-1][0] == c:
            out[stack.pop()[1]] = m.start()
        else:
            stack.clear()
            whole = False
    return out, whole and not stack


def close_of(clean: str, at: int) -> int:
    """Where the bracket at ``at`` is closed, or -1."""
    return _closings(clean)[0].get(at, -1)


def unmatched(clean: str) -> int:
    """Brackets without a partner: how far the file could be read."""
    if _closings(clean)[1]:
        return 0
    stack, bad = [], 0
    for c in _BRACKET.findall(clean):
        if c in _PAIRS:
            stack.append(_PAIRS[c])
        elif stack and stack[-1] == c:
            stack.pop()
        else:
            bad += 1
    return bad + len(stack)


@dataclass
class Item:
    start: int
    head_end: int  # the brace, or the end without one
    end: int  # past the item
    body: tuple[int, int] | None


_BEGIN = re.compile(r"[^\s;,]")


@functools.cache
def _turns(ends: str) -> re.Pattern:
    """What ends an item, or opens or closes something in it."""
    return re.compile(rf"[(\[={{}}{re.escape(ends)}]")


def items(clean: str, lo: int, hi: int, ends: str = ";") -> list[Item]:
    """Items at the top of a region: a head that ends in a body or at one of ``ends``."""
    out, i, start, assigned, turns = [], lo, -1, False, _turns(ends)
    while i < hi:
        if start < 0:
            if not (m := _BEGIN.search(clean, i, hi)):
                break
            i = start = m.start()
            assigned = False
        if not (m := turns.search(clean, i, hi)):
            break
        i, c = m.start(), m[0]
        if c in "([":
            j = close_of(clean, i)
            i = (j if 0 <= j < hi else i) + 1
            continue
        if c == "=" and clean[i : i + 2] not in ("==", "=>") and clean[i - 1] not in "=<>!" and not _OPERATOR.search(clean, max(start, i - 16), i):
            assigned = True
        if c == "{":
            j = close_of(clean, i)
            j = j if 0 <= j < hi else hi - 1
            if assigned:
                i = j + 1
                continue
            out.append(Item(start, i, j + 1, (i + 1, j)))
            start, i = -1, j + 1
            continue
        if c in ends:
            out.append(Item(start, i, i + 1, None))
            start = -1
        elif c == "}":
            start = -1
        i += 1
    if start >= 0 and clean[start:hi].strip():
        out.append(Item(start, hi, hi, None))
    return out


def split_top(clean: str, lo: int, hi: int, at: str = ",", angles: bool = False) -> list[tuple[int, int]]:
    """The regions between separators that no bracket holds."""
    if clean.find(at, lo, hi) < 0:
        return [(lo, hi)]
    out, i, start, depth = [], lo, lo, 0
    while i < hi:
        c = clean[i]
        if c in _PAIRS:
            j = close_of(clean, i)
            i = j if 0 <= j < hi else i
        elif angles and c == "<":
            depth += 1
        elif angles and c == ">" and clean[i - 1] not in "-=":
            depth = max(0, depth - 1)
        elif c == at and not depth:
            out.append((start, i))
            start = i + 1
        i += 1
    return [*out, (start, hi)]


class Depths:
    """Open braces before a position, counted from the position that was asked last."""

    def __init__(self, clean: str):
        self.clean, self.at, self.open = clean, 0, 0

    def __getitem__(self, i: int) -> int:
        lo, hi, sign = (self.at, i, 1) if i >= self.at else (i, self.at, -1)
        self.open += sign * (self.clean.count("{", lo, hi) - self.clean.count("}", lo, hi))
        self.at = i
        return self.open


class Lines:
    def __init__(self, source: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]

    def of(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)


def one_line(text: str) -> str:
    return " ".join(text.split())


_MARKER = re.compile(r"\s*(@\w+(\(.*\))?|#\[.*\])\s*$")


def doc_before(source: str, at: int, marks: tuple[str, ...]) -> str | None:
    """The comment that ends on the line above, without its marks; ordinary comments between break it."""
    end = at
    while end and source[end - 1] in " \t":
        end -= 1
    if not source.startswith("\n", end - 1):
        end = source.rfind("\n", 0, at) + 1
    above = source[source.rfind("\n", 0, max(end - 1, 0)) + 1 : max(end - 1, 0)].strip()
    if not end or above[:1] not in ("@", "#") and not above.endswith("*/") and not above.startswith(marks):
        return None
    rows = source[: end - 1].split("\n")
    while rows and _MARKER.match(rows[-1]):  # markers stand between
        rows.pop()
    if rows and rows[-1].rstrip().endswith("*/"):
        block = []
        while rows:
            block.insert(0, rows.pop())
            if "/*" in block[0]:
                break
        if not block[0].lstrip().startswith("/**"):
            return None
        text = re.sub(r"^\s*/\*\*|\*/\s*$", "", "\n".join(block))
        return "\n".join(re.sub(r"^\s*\*? ?", "", r) for r in text.split("\n")).strip() or None
    own = []
    while rows and rows[-1].strip().startswith(marks):
        own.insert(0, re.sub(r"^\s*//[/!]? ?", "", rows.pop()))
    return "\n".join(own).strip() or None
