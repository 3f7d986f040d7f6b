"""Text search over lines with context, caps and a byte budget; span merging; windows over lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions import text as X
from stratagraph.operators.ordered import ADDED, before, dealt, islands, neighbours

# Caps of a search answer and of shown sources.
MAX_MATCHES, MAX_LINE_BYTES, MAX_CONTEXT, MAX_BYTES = 200, 500, 5, 100_000
MAX_SOURCE_BYTES, MAX_SOURCE_CONTEXT = 32_000, 20


def lines(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, line_no, line), numbered from 1."""
    return files.select(F.col(file).alias("file"), F.posexplode(X.lines(F.col(text))).alias("p", "line")).select("file", (F.col("p") + 1).alias("line_no"), "line")


def search(files: DataFrame, pattern: str, scope: str = "", ignore_case: bool = False, context: int = 0, max_results: int = MAX_MATCHES) -> DataFrame:
    """Matching lines in order of (file, line): (file, line_no, line, truncated, before, after).

    Stops after ``max_results`` matches, and with the match that crosses the byte budget. Each task
    keeps its first matches before one small task applies the budget, so the plan is a top-k.
    """
    from stratagraph.functions.paths import within_scope

    wanted = min(max_results, MAX_MATCHES)
    regex = f"(?i){pattern}" if ignore_case else pattern
    found = files.where(within_scope(F.col("file"), scope)).where(F.regexp_like("text", F.lit(f"(?m){regex}"))).withColumn("own", X.lines(F.col("text")))
    hits = F.filter(F.transform("own", lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line"))), lambda r: r.line.rlike(regex))
    first = found.select("file", "own", F.explode(F.slice(hits, 1, wanted)).alias("h")).select("file", "own", "h.*").orderBy("file", "line_no").limit(wanted)
    capped = X.cap_bytes(F.col("line"), MAX_LINE_BYTES)
    c = min(context, MAX_CONTEXT)
    cut = lambda lo, hi: F.slice("own", F.greatest(lo, F.lit(1)), F.greatest(F.least(hi, F.size("own")) - F.greatest(lo, F.lit(1)) + 1, F.lit(0)))
    rows = first.select("file", "line_no", capped.alias("c"), cut(F.col("line_no") - c, F.col("line_no") - 1).alias("before"), cut(F.col("line_no") + 1, F.col("line_no") + c).alias("after"))
    so_far = F.sum(F.octet_length("c.text")).over(Window.orderBy("file", "line_no").rowsBetween(Window.unboundedPreceding, -1))  # at most MAX_MATCHES rows
    rows = rows.withColumn("so_far", F.coalesce(so_far, F.lit(0))).where(F.col("so_far") < MAX_BYTES)
    return rows.select("file", "line_no", F.col("c.text").alias("line"), F.col("c.truncated").alias("truncated"), "before", "after")


def merge_spans(spans: DataFrame, key: str, start: str = "start", end: str = "end", gap: int = 2) -> DataFrame:
    """(key, start, end): spans joined where the next starts no more than ``gap`` lines after the last end so far."""
    marked = islands(spans, key, [start, end], start, end, lambda at, last: at > last + gap)
    return marked.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def context(rows: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """Each row with up to ``n`` values before and after it; no task holds a whole key."""
    return neighbours(rows, key, [order], value, n)


def number_repeats(rows: DataFrame, key: str, order: list[str], joiner: str) -> DataFrame:
    """The rows, the key with its place appended from the second of equal keys on."""
    counted = before(dealt(rows.withColumn("_one", F.lit(1)), key, order), key, order, "_one", "_before")
    place = F.concat(F.col(key), F.lit(joiner), (F.col("_before") + 1).cast("string"))
    return counted.withColumn(key, F.when(F.col("_before").isNull(), F.col(key)).otherwise(place)).drop(*ADDED, "_one", "_before")


def byte_budget(rows: DataFrame, key: str, order: list[str], size: str, most: int) -> DataFrame:
    """Rows of each key in order until the budget is reached; the row that crosses it is the last."""
    summed = before(dealt(rows, key, order), key, order, size, "_before")
    return summed.where(F.coalesce("_before", F.lit(0)) < most).drop(*ADDED, "_before")


def first_pending(rows: DataFrame, key: str, order: list[str], pending: Column) -> DataFrame:
    """The first pending row of each key: a min aggregate over the pending rows."""
    cols = [c for c in rows.columns if c != key]
    return rows.where(pending).groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("r")).select(key, "r.*")
