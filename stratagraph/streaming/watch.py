"""A streaming source of file changes: polls a tree and reports what was added, edited or removed.

Spark's own file source reports new files only and hides names that start with ``_`` or ``.``.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "file string, action string, ts timestamp, source_hash string, text string"


def state_of(root: str) -> dict[str, list]:
    """Path to (time of change in ns, size) of all visible files."""
    from stratagraph.sources.repo import walk

    out = {}
    for p in walk(root):
        try:
            s = Path(root, p).stat()
        except OSError:  # it went meanwhile
            continue
        out[p] = [s.st_mtime_ns, s.st_size]
    return out


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": {}, "n": 0}

    def _rows(self, old: dict, new: dict) -> list[tuple]:
        import datetime as dt

        from stratagraph.extract.model import digest

        now, rows = dt.datetime.now(dt.timezone.utc), []
        for p in sorted(set(old) | set(new)):
            if p not in new:
                rows.append((p, "removed", now, None, None))
            elif old.get(p) != new[p]:
                try:
                    text = Path(self.root, p).read_bytes().decode()
                except (OSError, UnicodeDecodeError):
                    rows.append((p, "removed", now, None, None))
                    continue
                rows.append((p, "modified" if p in old else "added", now, digest(text), text))
        return rows

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        files = state_of(self.root)
        rows = self._rows(start["files"], files)
        return iter(rows), {"files": files, "n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(self._rows(start["files"], end["files"]))

    def commit(self, end: dict) -> None:
        time.sleep(0)


class FileWatch(DataSource):
    """``spark.readStream.format("file_watch").option("root", ...)``"""

    @classmethod
    def name(cls) -> str:
        return "file_watch"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Reader(self.options["root"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileWatch)
