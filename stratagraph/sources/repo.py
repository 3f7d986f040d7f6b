"""Source trees as DataFrames: the paths a repository shows, and their texts.

Spark's own file sources hide names that start with ``_`` or ``.`` and skip empty files, so the
driver lists paths (with the ignore rules) and executors read them.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions.paths import role, source_kind

#: Build outputs that are read although ignore rules hide them.
GENERATED_DIRS = ["target/generated-sources", "build/generated"]


class _Rules:
    """Ignore rules of one folder."""

    def __init__(self, base: str, text: str):
        self.base, self.rules = base, []
        for row in text.splitlines():
            row = row.strip()
            if row and not row.startswith("#"):
                keep, row = row.startswith("!"), row.removeprefix("!")
                only_dirs, row = row.endswith("/"), row.rstrip("/")
                self.rules.append((keep, only_dirs, "/" in row, row.lstrip("/")))

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        own, out = path[len(self.base) :].lstrip("/"), None
        for keep, only_dirs, anchored, pattern in self.rules:
            names = [own] if anchored else [own, own.rpartition("/")[2]]
            if (is_dir or not only_dirs) and any(fnmatch.fnmatch(n, pattern.replace("**/", "*").replace("/**", "/*")) for n in names):
                out = not keep
        return out


def walk(root: str, ignore: bool = True) -> list[str]:
    """Relative paths of all files that no ignore rule hides, sorted."""
    found: list[str] = []

    def visit(folder: str, rules: list[_Rules]) -> None:
        own = Path(root, folder, ".gitignore")
        if ignore and own.is_file():
            rules = [*rules, _Rules(folder, own.read_text(errors="replace"))]
        with os.scandir(Path(root, folder)) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                path = f"{folder}/{e.name}".lstrip("/")
                hidden = False
                for r in rules:
                    verdict = r.verdict(path, e.is_dir())
                    hidden = hidden if verdict is None else verdict
                if e.name == ".git" or hidden:
                    continue
                if e.is_dir(follow_symlinks=False):
                    visit(path, rules)
                elif e.is_file():
                    found.append(path)

    visit("", [])
    return found


def generated(root: str, paths: list[str]) -> list[str]:
    """Files below the build-output folders of the walked directories, ignore rules off."""
    bases = {"", *(p.rpartition("/")[0] for p in paths)}
    bases |= {b.rpartition("/src")[0] for b in bases if "/src" in f"/{b}"}
    out = set()
    for base in bases:
        for g in GENERATED_DIRS:
            top = Path(root, base, g)
            if top.is_dir():
                out |= {f"{base}/{g}/{p}".lstrip("/") for p in walk(str(top), ignore=False)}
    return sorted(out - set(paths))


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, texts = [], []
            for file in batch.column("file").to_pylist():
                try:
                    texts.append(Path(root, file).read_bytes().decode("utf-8"))
                    files.append(file)
                except (OSError, UnicodeDecodeError):  # an unreadable file is left out, the scan goes on
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(texts, pa.string())], names=["file", "text"])

    return run


def read(spark: SparkSession, root: str, paths: list[str], partitions: int | None = None) -> DataFrame:
    """(file, text) of the paths that can be read as UTF-8."""
    rows = spark.createDataFrame([(p,) for p in paths], "file string")
    return rows.repartition(partitions or len(paths) // 64 + 1).mapInArrow(_read(root), "file string, text string")


def routed(files: DataFrame, pack: str) -> DataFrame:
    """Files that the pack reads, with their kind and role."""
    own = files.withColumn("k", source_kind(F.col("file"))).where(F.col("k.pack") == pack)
    return own.select("file", "text", F.lit(pack).alias("pack"), F.col("k.kind").alias("source_kind"), role(F.col("file"), F.lit(pack)).alias("role"))


def detect(spark: SparkSession, paths: list[str]) -> str:
    """The one pack that claims the repository by its code outside tests; an error with the counts otherwise."""
    rows = spark.createDataFrame([(p,) for p in paths], "file string").withColumn("k", source_kind(F.col("file"))).where("k.kind = 'code'")
    rows = rows.where(role(F.col("file"), F.col("k.pack")) == "domain")
    counts = {r.pack: r.n for r in rows.groupBy("k.pack").agg(F.count("*").alias("n")).collect()}
    if len(counts) != 1:
        raise ValueError(f"exactly one pack must claim the repository; files: {counts or 'none'}")
    return next(iter(counts))


def known_names(root: str, pack: str, paths: list[str]) -> dict[str, str]:
    """What the manifests say about import names: TypeScript path aliases, Rust libraries and their source folders."""
    import json
    import re
    import tomllib

    out: dict[str, str] = {}
    if pack == "typescript":
        for p in paths:
            if p.rpartition("/")[2] == "tsconfig.json":
                text = re.sub(r"//[^\n\"]*$|/\*.*?\*/", "", Path(root, p).read_text(errors="replace"), flags=re.M | re.S)
                try:
                    options = json.loads(re.sub(r",(\s*[}\]])", r"\1", text)).get("compilerOptions", {})
                except ValueError:
                    continue
                folder = p.rpartition("/")[0]
                base = os.path.normpath(os.path.join(folder, options.get("baseUrl", ".")))
                for alias, to in options.get("paths", {}).items():
                    if alias.endswith("*") and to:
                        own = os.path.normpath(os.path.join(base, to[0].rstrip("*")))
                        out[alias[:-1]] = "" if own == "." else own + "/"
    if pack == "rust":
        for p in paths:
            if p.rpartition("/")[2] == "Cargo.toml":
                try:
                    manifest = tomllib.loads(Path(root, p).read_text(errors="replace"))
                except tomllib.TOMLDecodeError:
                    continue
                name = manifest.get("lib", {}).get("name") or manifest.get("package", {}).get("name")
                if name:
                    out[name.replace("-", "_")] = os.path.normpath(os.path.join(p.rpartition("/")[0], "src"))
    return out
