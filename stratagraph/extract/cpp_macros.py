"""Macros that stand where C++ grammar has no place for them, as spaces of the same length.

Works on text whose comments, strings and directives are blank already. Only names in capitals
are taken for macros, and only at places where a declaration can't hold a name; the rules run
again until nothing more is found, since one macro may hide another.
"""

from __future__ import annotations

import re

from stratagraph.extract import braces as B

_NAME = r"[A-Z][A-Z0-9_]{2,}"
#: Compiler attributes; their arguments are in balanced parentheses.
_ATTRIBUTE = re.compile(r"\b(?:__attribute__|__declspec|alignas|__pragma|_Pragma)\s*(?=\()")
_BRACKETS = re.compile(r"\[\[[^\[\]]*(?:\[[^\[\]]*\][^\[\]]*)*\]\]")
_CLASS_HEAD = re.compile(rf"\b(?:class|struct|union|enum(?:\s+class|\s+struct)?)\s+(?P<macro>{_NAME})(?=\s*\(|\s+[A-Za-z_])")
_BEFORE = re.compile(rf"(?P<macro>{_NAME})(?=\s*\(|\s)")  # where a declaration may begin
_AFTER = re.compile(rf"\)\s*(?:(?:const|noexcept|override|final|volatile)\s+)*(?P<macro>{_NAME})(?=\s*[;{{=(]|\s+{_NAME})")
_MEMBER = re.compile(rf"[\w>*&\]]\s+[*&]*[A-Za-z_]\w*\s+(?P<macro>{_NAME})(?=\s*\()")
_ALONE = re.compile(rf"(?m)^[ \t]*(?P<macro>{_NAME})[ \t]*(?=\(|$)")
_LABEL = re.compile(rf"(?:^|[;{{}}:])\s*(?P<macro>(?:(?:public|private|protected)\s+)?(?:{_NAME}|signals|slots)\s*:)(?!:)")
_INSTANCE = re.compile(r"(?<![\w:])(?:extern\s+)?template\s+(?!<)[^;{}<]*(?:<[^;{}]*>)?[^;{}]*;")
_MODULE = re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:module|import)\b(?:\s+[\w.:]+|\s*<[^>\n]*>|\s*:\s*\w+)?\s*;|(?<![\w:])export\b(?=\s+[\w:{])")
_TYPE_START = re.compile(r"\s*(?:[A-Za-z_]\w*)(?:\s*::\s*\w+|\s*<[^<>;{}]*>)*[\s*&]+[A-Za-z_~]")
#: What a text must hold for the rules above that are slow to fail.
_ATTRIBUTES = ("__attribute__", "__declspec", "alignas", "__pragma", "_Pragma")
_MODULES = ("module", "import", "export")
_LABELLED = re.compile(r":(?:(?<=[A-Z0-9_]{2}:)|(?<=[lt]s:)|(?<=\s:))(?!:)")
_CALLED = re.compile(rf"\s{_NAME}\s*\(")
_ARGUMENTS = re.compile(r"\s*\(")
_SEEN = re.compile(r"\s*(\S)")
_IN_LINE = re.compile(r"[^\n]+")
_CLASS_NAME = re.compile(r"\s*([A-Za-z_]\w*)")
_OPERATOR = re.compile(r"\s*(?:operator)\b")
_ANOTHER = re.compile(rf"\s+{_NAME}\b")
_TEMPLATE = re.compile(r"\btemplate\s*(?=<)")
_WORDS = {"NULL", "TRUE", "FALSE", "EOF"}


def _wipe(text: str, a: int, b: int) -> str:
    return text[:a] + spaces(text[a:b]) + text[b:]


def spaces(text: str) -> str:
    return _IN_LINE.sub(lambda m: " " * len(m[0]), text) if "\n" in text else " " * len(text)


def _call_end(text: str, at: int) -> int:
    """Past the arguments that follow ``at``, or ``at`` itself."""
    m = _ARGUMENTS.match(text, at)
    if not m:
        return at
    end = B.close_of(text, m.end() - 1)
    return end + 1 if end >= 0 else at


def _next(text: str, at: int) -> str:
    m = _SEEN.match(text, at)
    return m[1] if m else ""


def _previous(text: str, at: int) -> str:
    return text[:at].rstrip()[-1:] if at else ""


def blank_branches(text: str, directives: list[tuple[int, int, str]]) -> str:
    """Where the first branch of a conditional leaves braces open, only it is kept: the others would open them again."""
    stack: list[list[tuple[int, int, str]]] = []
    for d in directives:
        word = d[2]
        if word.startswith("if"):
            stack.append([d])
        elif stack and word in ("else", "elif", "elifdef", "elifndef"):
            stack[-1].append(d)
        elif stack and word == "endif":
            own = [*stack.pop(), d]
            first = text[own[0][1] : own[1][0]]
            if len(own) > 2 and first.count("{") != first.count("}"):
                text = _wipe(text, own[1][1], own[-1][0])
    return text


def template_end(text: str, at: int) -> int:
    """Past the ``>`` that closes the ``<`` at ``at``, or -1. Parentheses hide what they hold."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c in "([{":
            i = B.close_of(text, i)
            if i < 0:
                return -1
        elif c == "<":
            depth += 1
        elif c == ">" and text[i - 1] != "-":
            depth -= 1
            if not depth:
                return i + 1
        elif c == ";":
            return -1
        i += 1
    return -1


def blank_templates(text: str) -> str:
    """``template <...>`` heads and the constraints that follow them as spaces."""
    for m in list(_TEMPLATE.finditer(text)) if "template" in text else ():
        end = template_end(text, m.end())
        if end < 0 or not text[m.start() : m.start() + 8] == "template":
            continue
        while r := re.compile(r"\s*requires\b").match(text, end):
            end = r.end()
            while p := re.compile(r"\s*(?:&&|\|\||!)?\s*(?:(?=\()|[\w:]+(?=\s*[<({&|]|\s+[A-Za-z_]))").match(text, end):
                before, end = end, p.end()
                if text[end : end + 1] == "<":
                    end = template_end(text, end)
                elif text[end : end + 1] == "(":
                    end = B.close_of(text, end) + 1
                if end <= before or not re.compile(r"\s*(?:&&|\|\|)").match(text, end):
                    break
            end = max(end, r.end())
        text = _wipe(text, m.start(), end)
    return text


def blank_macros(text: str) -> str:
    for m in list(_ATTRIBUTE.finditer(text)) if any(w in text for w in _ATTRIBUTES) else ():
        text = _wipe(text, m.start(), _call_end(text, m.end()))
    for pattern, words in ((_BRACKETS, ("[[",)), (_INSTANCE, ("template",)), (_MODULE, _MODULES)):
        if not any(w in text for w in words):
            continue
        text = pattern.sub(lambda m: spaces(m[0]), text)
    for _ in range(6):  # annotations in a row; more passes than declarations have
        found = _found(text)
        if not found:
            break
        for a, b in found:
            text = _wipe(text, a, b)
    return text


def _found(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CLASS_HEAD.finditer(text):
        end = _call_end(text, m.end("macro"))
        name = _CLASS_NAME.match(text, end)
        if name and name[1] != "final":  # a name follows: this one is not the class's own
            out.append((m.start("macro"), end))
    if out:  # what follows a class's macro is its name, not an annotation: the other rules wait for the next pass
        return out
    for m in _LABEL.finditer(text) if _LABELLED.search(text) else ():
        if m["macro"].rstrip(":").strip() not in ("public", "private", "protected"):
            out.append((m.start("macro"), m.end("macro")))
    for m in _BEFORE.finditer(text):
        at = m.start()
        while at and text[at - 1].isspace():
            at -= 1
        if at and text[at - 1] not in ";{}:":
            continue
        end = _call_end(text, m.end("macro"))
        if m["macro"] in _WORDS or text[end : end + 1] not in (" ", "\n", "\t"):
            continue
        if _TYPE_START.match(text, end) and not _OPERATOR.match(text, end):  # a whole declaration follows
            out.append((m.start("macro"), end))
    for pattern in (_AFTER, _MEMBER) if _CALLED.search(text) else (_AFTER,):
        for m in pattern.finditer(text):
            end = _call_end(text, m.end("macro"))
            if m["macro"] not in _WORDS and _next(text, end) in (";", "{", "=", ":") or _ANOTHER.match(text, end):
                out.append((m.start("macro"), end))
    for m in _ALONE.finditer(text):
        end = _call_end(text, m.end("macro"))
        line_end = text.find("\n", end)
        if text[end : line_end if line_end >= 0 else len(text)].strip() or _previous(text, m.start("macro")) not in ("", ";", "}", ")", ":", "{"):
            continue
        after = _next(text, end)
        listed = _previous(text, m.start("macro")) in ("{", ",") and after in ("}", ",")
        if not listed and after not in ("{", ";", ":", ",", "=", "("):
            out.append((m.start("macro"), end))
    return out
