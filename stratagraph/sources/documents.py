"""Stored documents: Markdown with a front matter of recorded hashes."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession

from stratagraph.extract.model import digest
from stratagraph.functions.text import PROVENANCE

ROOT = "docs/specs"


@dataclass
class Document:
    """kind: file, rollup, feature or system; children: (id, hash) pairs as recorded."""

    kind: str
    id: str
    summary: str = ""
    source_hash: str = ""
    fingerprint: str = ""
    deps_hash: str = ""
    spec_hash: str = ""
    children: list[tuple[str, str]] = field(default_factory=list)
    dep_targets: list[tuple[str, str, str]] = field(default_factory=list)  # owner, target, first 12 of its hash
    sections: dict[str, dict[str, str]] = field(default_factory=dict)  # symbol id to hashes, summary and behavior
    signatures: dict[str, str] = field(default_factory=dict)  # as last generated
    contents: dict[str, list[tuple[str, str]]] = field(default_factory=dict)  # heading to (id, first line of its summary)


def path_of(kind: str, id_: str) -> str:
    """Where a document lies below the folder of documents."""
    return {"file": f"{id_}.md", "rollup": f"{id_.removeprefix('rollup:')}/_index.md", "feature": f"_features/{id_.removeprefix('feature:')}.md", "system": "_index.md"}[kind]


def link(doc: Document, target: str) -> str:
    """The relative path from a document to that of a symbol, a file, a folder or a feature."""
    own = path_of(doc.kind, doc.id).split("/")[:-1]
    kind = "rollup" if target.startswith("rollup:") else "feature" if target.startswith("feature:") else "file"
    there = path_of(kind, target.split("::")[0]).split("/")
    while own and there[:-1] and own[0] == there[0]:
        own, there = own[1:], there[1:]
    anchor = f"#{re.sub(r'[^a-z0-9_-]+', '', target.rpartition('::')[2].lower())}" if "::" in target else ""
    return quote("/".join([".."] * len(own) + there), safe="/.") + anchor


def quoted(value: str) -> str:
    """A front matter value: plain where it reads back as itself, else in double quotes."""
    if value and re.fullmatch(r"[\w./:@+-][\w ./:@+-]*(?<! )", value) and ": " not in value and value.lower() not in ("true", "false", "null", "yes", "no", "~"):
        return value
    return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def unquoted(value: str) -> str:
    value = value.strip()
    if len(value) >= 2 and value[0] == value[-1] == '"':
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], value[1:-1])
    return value


#: Keys of older documents, and what they are called now.
OLD_KEYS = {"type": "kind", "source": "id", "hashes": "file", "deps": "dep_targets", "files": "children"}


def migrate_keys(text: str) -> str:
    """An older document under the present keys, with the provenance line and title; a present one as it is."""
    m = re.match(r"---\n(.*?)\n---\n(.*)\Z", text, re.S)
    if not m:
        raise ValueError("a document starts with its front matter")
    rows = [row if row.startswith(" ") else OLD_KEYS.get(row.partition(":")[0], row.partition(":")[0]) + row[len(row.partition(":")[0]) :] for row in m[1].split("\n")]
    id_ = next((unquoted(r.partition(":")[2]) for r in rows if r.startswith("id:")), "")
    body = m[2]
    if not re.match(r"# ", body):
        body = f"# {id_}\n{body}"
    title, _, rest = body.partition("\n")
    if not rest.startswith(PROVENANCE):
        rest = f"{PROVENANCE}\n{rest}"
    rest = re.sub(r"\]\(((?:\.\./)*)specs/", r"](\1", rest)
    return "---\n" + "\n".join(rows) + f"\n---\n{title}\n{rest}"


def _flow(text: str) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (p.partition(":") for p in text.strip().strip("{}").split(",")) if k.strip()}


def render(doc: Document) -> str:
    out = ["---", f"kind: {doc.kind}", f"id: {quoted(doc.id)}", f"file: {{ source_hash: {doc.source_hash}, fingerprint: {doc.fingerprint}, deps_hash: {doc.deps_hash}, spec_hash: {doc.spec_hash} }}"]
    if doc.children:
        out += ["children:", *(f"  {c} = {h}" for c, h in doc.children)]
    if doc.sections:
        out += ["symbols:", *(f"  {s} = {{ source_hash: {h.get('source_hash', '')}, deps_hash: {h.get('deps_hash', '')}, spec_hash: {h.get('spec_hash', '')} }}" for s, h in doc.sections.items())]
    if doc.dep_targets:
        out += ["dep_targets:", *(f"  {o} -> {t} = {h}" for o, t, h in doc.dep_targets)]
    out += ["---", f"# {doc.id}", PROVENANCE, "", "## Summary", doc.summary.strip(), ""]
    for s, h in doc.sections.items():
        out += [f"## `{s.rpartition('::')[2]}`", *([f"`{doc.signatures[s]}`"] if s in doc.signatures else []), "### Summary", h.get("summary", "").strip(), "### Behavior", h.get("behavior", "").strip()]
        targets = [t for o, t, _ in doc.dep_targets if o == s]
        out += ["### Depends on", *([f"- [`{t}`]({link(doc, t)})" for t in targets] or ["- (none)"]), ""]
    for heading, items in doc.contents.items():
        out += [f"## {heading}", *(f"- [`{i}`]({link(doc, i)}) — {blurb}".rstrip(" —") for i, blurb in items), ""]
    return "\n".join(out).rstrip("\n") + "\n"


def parse(text: str) -> Document:
    """The inverse of ``render``; raises ValueError for other text."""
    m = re.match(r"---\n(.*?)\n---\n(.*)\Z", text, re.S)
    if not m:
        raise ValueError("a document starts with its front matter")
    doc, block = Document("file", ""), ""
    for row in m[1].split("\n"):
        if row.startswith("  "):
            key, _, value = row[2:].rpartition(" = ")
            if block == "children":
                doc.children.append((key, value))
            elif block == "symbols":
                doc.sections[key] = _flow(value)
            elif block == "dep_targets":
                owner, _, target = key.partition(" -> ")
                doc.dep_targets.append((owner, target, value))
            continue
        key, _, value = row.partition(":")
        block = key
        if key in ("kind", "id"):
            setattr(doc, key, unquoted(value))
        elif key == "file":
            for k, v in _flow(value).items():
                setattr(doc, k, v)
    parts = re.split(r"(?m)^## (.*)\n", m[2])
    bodies = dict(zip(parts[1::2], parts[2::2], strict=True))
    doc.summary = bodies.get("Summary", "").strip()
    for s, h in doc.sections.items():
        body = bodies.get(f"`{s.rpartition('::')[2]}`", "")
        cut = re.split(r"(?m)^### (Summary|Behavior|Depends on)\n", body)
        own = dict(zip(cut[1::2], cut[2::2], strict=True))
        if shown := re.match(r"`(.*)`\n", cut[0]):
            doc.signatures[s] = shown[1]
        h["summary"], h["behavior"] = own.get("Summary", "").strip(), own.get("Behavior", "").strip()
    return doc


def body_hash(doc: Document, section: str | None = None) -> str:
    """What ``spec_hash`` records: another value means that someone edited the text."""
    if section is None:
        return digest(doc.summary.strip())
    h = doc.sections[section]
    return digest(f"{h.get('summary', '').strip()}\n{h.get('behavior', '').strip()}")


def write(root: str, doc: Document) -> Path:
    """Replace a document as a whole: a temporary file, synced, renamed."""
    path = Path(root, ROOT, path_of(doc.kind, doc.id))
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(".md.tmp")
    with new.open("w") as f:
        f.write(render(doc))
        f.flush()
        os.fsync(f.fileno())
    os.replace(new, path)
    return path


def load(root: str) -> tuple[list[Document], list[str]]:
    """All documents, and the paths of those that can't be read."""
    docs, bad = [], []
    for path in sorted(Path(root, ROOT).rglob("*.md")):
        try:
            docs.append(parse(path.read_text()))
        except (ValueError, UnicodeDecodeError):
            bad.append(str(path.relative_to(Path(root, ROOT))))
    return docs, bad


DOCS = "doc_kind string, doc_id string, summary string, source_hash string, fingerprint string, deps_hash string, spec_hash string, edited boolean"
SECTIONS = "doc_id string, symbol_id string, source_hash string, deps_hash string, spec_hash string, summary string, behavior string, edited boolean"


def tables(spark: SparkSession, docs: list[Document]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """docs, sections, children (doc_id, child_id, hash) and dep_targets (owner, target, hash12)."""
    d = [(x.kind, x.id, x.summary, x.source_hash, x.fingerprint, x.deps_hash, x.spec_hash, bool(x.spec_hash) and body_hash(x) != x.spec_hash) for x in docs]
    s = [
        (x.id, k, h.get("source_hash", ""), h.get("deps_hash", ""), h.get("spec_hash", ""), h.get("summary", ""), h.get("behavior", ""), bool(h.get("spec_hash")) and body_hash(x, k) != h["spec_hash"])
        for x in docs
        for k, h in x.sections.items()
    ]
    c = [(x.id, child, h) for x in docs for child, h in x.children]
    t = [row for x in docs for row in x.dep_targets]
    make = spark.createDataFrame
    return make(d, DOCS), make(s, SECTIONS), make(c, "doc_id string, child_id string, hash string"), make(t, "owner string, target string, hash12 string")
