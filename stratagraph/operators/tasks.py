"""What a writer is shown of a file: its text, an outline of its dominant container, or its parts' summaries, in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import text as X
from stratagraph.operators import reports as R

PAGE = 32_000


def _lines(*parts: Column) -> Column:
    """Joined by newlines, without nulls and blanks."""
    return F.array_join(F.filter(F.array(*[p.cast("string") for p in parts]), lambda x: x.isNotNull() & (x != "")), "\n")


def _joined(symbols: Column, shown) -> Column:
    return F.array_join(F.transform(symbols, shown), "\n\n")


def file_inputs(files: DataFrame, symbols: DataFrame, summaries: DataFrame, page: int = PAGE, most: int = R.RAW_PAGES) -> DataFrame:
    """(file, input_kind, input, pages) of each of ``files(file, text)``.

    ``symbols(id, file, ord, kind, parent, signature, docstring, bytes, is_top_level)`` declares what the files hold,
    ``summaries(id, summary)`` what is written of it. A file of at most ``most`` pages is ``raw``. A larger one is an
    ``outline`` where one container holds most of it: the container's head, its members' heads and the heads of the
    other top-level declarations, without bodies. With many documented parts it is their ``summaries``, each below its
    head; where one has none it stays raw, so that a part is never taken for the whole. Nothing is cut: what is
    shown is paged. A null text is empty; a file without symbols is raw.
    """
    large = files.select("file", F.coalesce("text", F.lit("")).alias("text")).withColumn("_raw", X.pages(F.col("text"), page))
    one = F.struct("ord", "id", "kind", "parent", "signature", "docstring", F.coalesce("bytes", F.lit(0)).alias("bytes"), "is_top_level", "summary")
    written = summaries.where("summary <> ''").groupBy("id").agg(F.first("summary").alias("summary"))
    deep = large.where(F.size("_raw") > most).select("file")  # only large files' symbols are gathered, a file at a time
    own = symbols.join(deep, "file", "left_semi").join(written, "id", "left").groupBy("file").agg(F.array_sort(F.collect_list(one)).alias("_own"))
    rows = large.join(own, "file", "left")
    containers = F.filter("_own", lambda s: (s.kind == "container") & s.is_top_level)
    biggest = F.aggregate(containers, F.lit(None).cast(own.schema["_own"].dataType.elementType), lambda a, s: F.when(a.isNull() | (s.bytes > a.bytes), s).otherwise(a))
    parts = F.filter("_own", lambda s: s.is_top_level & s.kind.isin("callable", "container"))
    rows = rows.withColumn("_big", biggest).withColumn("_parts", parts)
    rung = R.ladder(F.size("_raw"), R.share_of(F.coalesce("_big.bytes", F.lit(0)), F.octet_length("text")), F.greatest(F.size("_parts"), F.lit(0)), most)
    head = lambda s: _lines(s.signature, s.docstring)
    top = _lines(F.concat(F.lit("FILE: "), "file"), X.leading_comment(F.col("text")))
    members = F.filter("_own", lambda s: s.parent == F.col("_big.id"))
    others = F.filter("_own", lambda s: s.is_top_level & (s.id != F.col("_big.id")))
    rest = F.filter("_own", lambda s: s.is_top_level & ~s.kind.isin("callable", "container"))
    outline = F.array_join(F.array(top, head(F.col("_big")), _joined(members, head), _joined(others, lambda s: s.signature)), "\n\n")
    told = F.array_join(F.array(top, _joined(F.col("_parts"), lambda s: _lines(s.signature, s.summary)), _joined(rest, lambda s: s.signature)), "\n\n")
    whole = F.coalesce(F.forall("_parts", lambda s: s.summary.isNotNull()), F.lit(False))
    kind = F.when((rung == "summaries") & ~whole, "raw").otherwise(rung)
    shown = rows.withColumn("input_kind", kind).withColumn("input", F.when(kind == "outline", outline).when(kind == "summaries", told).otherwise(F.col("text")))
    return shown.select("file", "input_kind", "input", F.when(F.col("input_kind") == "raw", F.col("_raw")).otherwise(X.pages(F.col("input"), page)).alias("pages"))
