"""Cut lineage in the folder that driver and executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one is made only where none is named, on a local master."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="stratagraph-checkpoint-")
    return _OWN[sc.applicationId]


def transient(spark: SparkSession) -> str:
    """A new path in that folder; what is written there is deleted when the driver's JVM ends."""
    path = f"{folder(spark)}/stratagraph-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read back; deleted when the driver's JVM ends.

    A table rather than ``checkpoint()``: the reread plan has the table's own size. A checkpoint keeps the size
    that was estimated for what made it, which grows with every round of an iteration until planning fails.
    """
    spark: SparkSession = df.sparkSession
    path = transient(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


#: Rows up to which the rounds of an iteration may broadcast a table, which sends it to the driver each time.
SENT = 1 << 15


def staying(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, as a side of a round's joins: above ``SENT`` it is shuffled, however small its files are."""
    return df.hint("merge") if rows > SENT else df


def chosen(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, as a side of a round's joins: up to ``SENT`` it is sent to all tasks, so that the other side stays where it is."""
    return df.hint("merge" if rows > SENT else "broadcast")


#: Where ``checkpointed`` frames lie, for as long as they are held.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def dropped(df: DataFrame) -> None:
    """Delete what ``checkpointed`` wrote for ``df``; only where no later plan reads it."""
    held, path = _PATHS.pop(id(df), (lambda: None, ""))
    if held() is df:
        place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``checkpointed``, and aggregates of the rows that were taken while they were written."""
    seen = Observation()
    out = checkpointed(df.observe(seen, *[c.alias(n) for n, c in measures.items()]))
    return out, seen.get
