"""Text functions as column expressions, and the few that need a loop as Arrow-batched functions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: phrases with which a text avoids saying anything.
COP_OUTS = [
    "see the source", "see source", "see the route handler", "see the handler", "see the file for details",
    "see the code for details", "refer to the source", "check the implementation", "check the source",
]
MIN_WORDS, STRAY_TAG = 4, "</content>"


def lines(text: Column) -> Column:
    """Lines as a reader counts them: a final newline ends the last line, carriage returns go."""
    cut = F.split(text, "\n")
    cut = F.when(F.endswith(text, F.lit("\n")), F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(1)))).otherwise(cut)
    return F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(cut), lambda x: F.regexp_replace(x, "\r$", ""))


def span(text: Column, start: Column, end: Column, context: int = 0) -> Column:
    """Lines start to end (from 1, inclusive) with context on both sides, clamped to the text."""
    own = lines(text)
    first = F.greatest(start - context, F.lit(1))
    last = F.least(end + context, F.size(own))
    return F.when(last < first, F.lit("")).otherwise(F.array_join(F.slice(own, first.cast("int"), (F.greatest(last - first, F.lit(-1)) + 1).cast("int")), "\n"))


def render_spans(text: Column, spans: Column) -> Column:
    """The line ranges (start, end) of a text, joined, with a blank line between blocks."""
    own = lines(text)
    return F.array_join(F.transform(spans, lambda s: F.array_join(F.slice(own, s["start"].cast("int"), (F.greatest(s["end"] - s["start"], F.lit(-1)) + 1).cast("int")), "\n")), "\n\n")


def plain_cpp_name(name: Column) -> Column:
    """A C++ name without template arguments (nested ones too) and white space."""
    for _ in range(4):
        name = F.regexp_replace(name, "<[^<>]*>", "")
    return F.regexp_replace(name, r"\s+", "")


def route_decorator(marker: Column) -> Column:
    """(verb, path) of a decorator or annotation that names a route: ``router.get("/x")``, ``@GET``; null for others."""
    call = r"""^@?[\w.]*?\.?(get|post|put|patch|delete|head|options|websocket)\(\s*[rf]?['"]([^'"]*)['"]"""
    bare = r"^@(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
    verb = F.coalesce(F.nullif(F.regexp_extract(marker, call, 1), F.lit("")), F.nullif(F.lower(F.regexp_extract(marker, bare, 1)), F.lit("")))
    return F.when(verb.isNotNull(), F.struct(verb.alias("verb"), F.regexp_extract(marker, call, 2).alias("path")))


def cap_bytes(text: Column, most: int) -> Column:
    """(text, truncated): at most so many UTF-8 bytes, cut between characters."""
    data = F.encode(text, "utf-8")

    def cut(n: int) -> Column:
        return F.try_validate_utf8(F.decode(F.substring(data, 1, n), "utf-8")) if n else F.lit("")

    # A character has at most four bytes: of the four possible ends the last that parts none is right.
    after = lambda n: F.conv(F.hex(F.substring(data, n + 1, 1)), 16, 10).cast("int")
    inside = lambda n: after(n).between(128, 191)
    whole = F.lit(max(most - 3, 0))
    for n in range(max(most - 2, 0), most + 1):
        whole = F.when(~inside(n), F.lit(n)).otherwise(whole)
    capped = F.decode(F.substring(data, F.lit(1), whole.cast("int")), "utf-8")
    long = F.octet_length(text) > most
    return F.struct(F.when(long, capped).otherwise(text).alias("text"), long.alias("truncated"))


def whole_word(text: Column, name: Column) -> Column:
    """The name stands in the text with no ASCII letter, digit, ``_`` or ``$`` on either side."""
    return F.expr("true") & F.regexp_like(text, F.concat(F.lit(r"(?<![A-Za-z0-9_$])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_$])")))


def words(text: Column) -> Column:
    """Distinct identifier words; joining on them replaces a regular expression per (text, name) pair."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_$]+)"), F.lit(1)))


def section(text: Column, heading: str) -> Column:
    """What follows a heading line, up to the next heading of any level; null without it."""
    found = F.regexp_extract(text, rf"(?s)(?:^|\n)#+ {re.escape(heading)}[ \t]*\n(.*?)(?:\n#+ |\z)", 1)
    return F.when(F.regexp_like(text, F.lit(rf"(?:^|\n)#+ {re.escape(heading)}[ \t]*\n")), F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")))


def smells(text: Column, code_span: Column | None = None) -> Column:
    """Sorted names of what is wrong with a prose text."""
    lower = F.lower(text)
    cop = F.exists(F.array(*map(F.lit, COP_OUTS)), lambda p: F.contains(lower, p))
    short = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) < MIN_WORDS
    tests = [("cop_out_phrase", cop), ("stray_markup", F.contains(text, F.lit(STRAY_TAG))), ("suspiciously_short", short)]
    if code_span is not None:
        tests.append(("unbalanced_code_span", code_span))
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda x: x.isNotNull())


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


def has_open_code_span(text: str) -> bool:
    """Whether a run of backticks has no equal partner in its block (fenced and indented code aside)."""
    block: list[str] = []
    fence = ""

    def open_in(rows: list[str]) -> bool:
        runs = [len(r) for r in re.findall(r"(?<!\\)`+", "\n".join(rows))]
        at = 0
        while at < len(runs):
            try:
                at = runs.index(runs[at], at + 1) + 1
            except ValueError:
                return True
        return False

    for row in [*text.split("\n"), ""]:
        mark = _FENCE.match(row)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not row.strip().strip(fence[0]):
                fence = ""
            continue
        if mark and not (mark[1][0] == "`" and "`" in row[mark.end() :]):
            if open_in(block):
                return True
            block, fence = [], mark[1]
        elif not row.strip() or (not block and row.startswith(("    ", "\t"))):
            if open_in(block):
                return True
            block = []
        else:
            block.append(row)
    return False


@F.pandas_udf(T.BooleanType())
def open_code_span(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: has_open_code_span(t) if t and "`" in t else False)


def page_text(text: str, size: int) -> list[str]:
    """Pages of at most ``size`` bytes, cut after the last newline that fits, else between characters."""
    data, pages, at = text.encode(), [], 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            line = data.rfind(b"\n", at, end)
            if line >= at:
                end = line + 1
            else:
                while end > at and data[end] & 0xC0 == 0x80:
                    end -= 1
                if end == at:  # a character larger than a page
                    end = at + 1
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end += 1
        pages.append(data[at:end].decode())
        at = end
    return pages or [""]


def pages(text: Column, size: int) -> Column:
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: page_text(t or "", size))

    return run(text)


def cap_with_marker(text: Column, most: int, marker: str) -> Column:
    """At most ``most`` bytes in all; a cut text ends with the marker."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cap_bytes(text, most - len(marker.encode())).text, F.lit(marker)))


def leading_comment(text: Column) -> Column:
    """The comment lines at the top of a file, up to the first blank or code line."""
    own = lines(text)
    stop = F.array_position(F.transform(own, lambda x: ~x.rlike(r"^\s*(//|#|/\*|\*|--)")), F.lit(True))
    return F.array_join(F.when(stop == 0, own).otherwise(F.slice(own, F.lit(1), (F.greatest(stop, F.lit(1)) - 1).cast("int"))), "\n")


def strip_initialiser(text: str) -> str:
    """A declaration without its value: cut at the first ``=`` outside brackets that assigns."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}") - (c == ">" and i > 0 and text[i - 1] not in "=-")
        if c == "=" and depth <= 0 and text[i + 1 : i + 2] not in ("=", ">") and (i == 0 or text[i - 1] not in "=!<>"):
            return text[:i].rstrip()
    return text


def strip_angles(text: str) -> str:
    """Without balanced ``<...>`` groups, however deep."""
    out, depth = [], 0
    for c in text:
        depth += c == "<"
        if not depth:
            out.append(c)
        depth -= c == ">" and depth > 0
    return "".join(out)


def _each(f):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return run


def stripped_initialiser(text: Column) -> Column:
    return _each(strip_initialiser)(text)


def stripped_angles(text: Column) -> Column:
    return _each(strip_angles)(text)


def link_destination(path: Column) -> Column:
    """A path as the target of a Markdown link: characters that end a link are escaped."""
    for plain, escaped in (("%", "%25"), (" ", "%20"), ("(", "%28"), (")", "%29"), ("[", "%5B"), ("]", "%5D")):
        path = F.replace(path, F.lit(plain), F.lit(escaped))
    return path


#: Marks a text as made, not written; stands on a line of its own below the title.
PROVENANCE = "_Generated from source; edits are kept._"


def with_provenance(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(PROVENANCE)), text).otherwise(F.regexp_replace(text, r"^(# [^\n]*)\n", "$1\n" + PROVENANCE + "\n"))


def without_provenance(text: Column) -> Column:
    return F.replace(text, F.lit(PROVENANCE + "\n"), F.lit(""))


def encode_cursor(page: int, file_id: str, text: str) -> str:
    """A page's cursor holds a hash of what is paged."""
    import hashlib

    return f"{page}:{hashlib.sha256(f'{file_id}\n{text}'.encode()).hexdigest()[:12]}"


def decode_cursor(cursor: str, file_id: str, text: str, size: int) -> int:
    """The page of a cursor; an error if it is malformed, out of range or of another text."""
    page, _, _ = cursor.partition(":")
    if not page.isdigit() or cursor != encode_cursor(int(page), file_id, text):
        raise ValueError("the cursor is of another text or malformed")
    if int(page) >= len(page_text(text, size)):
        raise ValueError("the cursor is out of range")
    return int(page)
