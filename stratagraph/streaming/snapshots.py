"""Versioned tables in buckets of a key, copied on write: a version rewrites only the buckets that it touches.

Tables and manifests lie in one folder of one Hadoop file system. A manifest names the folder of each bucket of each
table; versions share what did not change. A version is there once its manifest has been renamed to its number, which
fails where another writer took the number first. Readers keep the files they planned with until ``expire``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_IN = "snapshot_bucket"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Snapshots:
    """``publish`` writes whole tables, ``update`` the buckets that hold given keys; an empty bucket has no folder."""

    def __init__(self, root: str):
        self.root = str(root).rstrip("/")

    def _files(self):
        spark = SparkSession.active()
        path = spark._jvm.org.apache.hadoop.fs.Path
        return path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, spark._jvm

    def _numbers(self) -> list[int]:
        fs, path, _ = self._files()
        at = path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, number: int) -> dict:
        fs, path, jvm = self._files()
        stream = fs.open(path(f"{self.root}/manifests/{number:012d}.json"))
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict | None:
        """The newest manifest: its version, and per table the key, the schema and the folder of each bucket."""
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else None

    def read(self, spark: SparkSession, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table as of now; of the given buckets only, if any are given."""
        return self._read(spark, self.current()["tables"][table], buckets)

    @staticmethod
    def _read(spark: SparkSession, held: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(held["schema"])
        folders = [f for b, f in sorted(held["folders"].items()) if buckets is None or int(b) in buckets]
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, version: str, table: str, key: str, buckets: int) -> dict[str, str]:
        """The folders that hold the rows' buckets."""
        at = f"{self.root}/{version}/{table}"
        df.withColumn(_IN, bucket_of(key, buckets)).repartition(_IN).write.partitionBy(_IN).parquet(at)
        fs, path, _ = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(path(at)) if s.isDirectory()]
        return {n.split("=")[1]: f"{at}/{n}" for n in names if n.startswith(f"{_IN}=")}

    def _commit(self, version: str, tables: dict, number: int) -> str:
        fs, path, _ = self._files()
        fs.mkdirs(path(f"{self.root}/manifests"))
        made = path(f"{self.root}/manifests/{version}.tmp")
        out = fs.create(made, False)
        out.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
        out.close()
        to = path(f"{self.root}/manifests/{number:012d}.json")
        if fs.exists(to) or not fs.rename(made, to):
            fs.delete(made, False)
            raise RuntimeError("another writer has published in the meantime")
        return version

    def publish(self, tables: dict[str, DataFrame], key: str = "file", buckets: int = BUCKETS) -> str:
        """A version of whole tables."""
        numbers, version = self._numbers(), uuid.uuid4().hex
        held = {n: {"key": key, "buckets": buckets, "schema": json.loads(df.schema.json()), "folders": self._write(df, version, n, key, buckets)} for n, df in tables.items()}
        return self._commit(version, held, (numbers[-1] if numbers else 0) + 1)

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets that hold the rows' keys; as many at most as the table has."""
        held = self.current()["tables"][table]
        return sorted(r[0] for r in rows.select(bucket_of(held["key"], held["buckets"])).distinct().collect())

    def update(self, table: str, changed: DataFrame, merged) -> str:
        """A version in which the buckets of ``changed``'s keys hold ``merged(their rows as of now)``; the others stay."""
        numbers, version = self._numbers(), uuid.uuid4().hex
        tables = self._manifest(numbers[-1])["tables"]
        held = tables[table]
        at = self.touched(table, changed)
        fresh = self._write(merged(self._read(changed.sparkSession, held, at)), version, table, held["key"], held["buckets"])
        if stray := {int(b) for b in fresh} - set(at):
            raise ValueError(f"rows of other buckets: {sorted(stray)}")
        kept = {b: f for b, f in held["folders"].items() if int(b) not in at}
        return self._commit(version, {**tables, table: {**held, "folders": {**kept, **fresh}}}, numbers[-1] + 1)

    def expire(self, keep: int = 2) -> int:
        """Delete all but the newest ``keep`` versions, and the folders that only those used; the number of folders."""
        fs, path, _ = self._files()
        numbers = self._numbers()
        old, new = numbers[:-keep], numbers[-keep:]
        folders = lambda ns: {f for n in ns for t in self._manifest(n)["tables"].values() for f in t["folders"].values()}
        gone = folders(old) - folders(new)
        for n in old:  # manifests first: no reader finds a version without its files
            fs.delete(path(f"{self.root}/manifests/{n:012d}.json"), False)
        for f in gone:
            fs.delete(path(f), True)
        return len(gone)
