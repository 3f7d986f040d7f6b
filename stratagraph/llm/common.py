"""What the operators of this subpackage share: shared-folder staging and row carrying."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none is a temporary folder made, and only on a local master.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="stratagraph-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/stratagraph-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


#: Where ``staged`` frames lie, for as long as they are held.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def unstage(df: DataFrame) -> None:
    """Delete what ``staged`` wrote for ``df``; only where no later plan reads it."""
    held, path = _PATHS.pop(id(df), (lambda: None, ""))
    if held() is df:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows and bytes that an Arrow batch to or from Python may have: what a task holds at once.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small (never larger than the session has them already).

    The plans are lazy and read the setting when they run, so it stays for the rest of the session: a
    documented side effect of every operator that reads texts in Python.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        digits = "".join(c for c in now or "" if c.isdigit())
        if not now or now != digits or not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; null texts become empty."""
    bounded_batches(df.sparkSession)
    return df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def carried(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The whole row as one struct beside its text, so that new columns cannot clash with old names."""
    bounded_batches(df.sparkSession)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
