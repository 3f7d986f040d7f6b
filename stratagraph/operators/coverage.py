"""Coverage of documents: inventory sums, ratios, priorities, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["file", "rollup", "feature", "system"]
PAGE, TOP_STALE, TOP_TARGETS, SHARED_RANK, SHARED_LEAST = 50, 5, 10, 8, 3


def _count(test: Column) -> Column:
    return F.count_if(test)


def sums() -> list[Column]:
    return [
        _count(F.col("status") == "current").alias("current"),
        _count(F.col("status") == "stale").alias("stale"),
        _count(F.col("status") == "missing").alias("missing"),
        _count(F.col("smelly")).alias("smelly"),
        F.count("*").alias("total"),
    ]


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def with_ratios(summary: DataFrame) -> DataFrame:
    """Adds freshness (current of documented) and coverage (documented of all); both are 1 of nothing."""
    done = F.col("current") + F.col("stale")
    return summary.withColumn("freshness", _ratio(F.col("current"), done)).withColumn("coverage", _ratio(done, F.col("total")))


def summarize(items: DataFrame, *by: str) -> DataFrame:
    return items.groupBy(*by).agg(*sums()) if by else items.agg(*sums())


def weighted_freshness(items: DataFrame, weight: str = "fan_in") -> DataFrame:
    """Freshness by weight; by count where all weights are 0; 1 where nothing is documented."""
    done, fresh = F.col("status").isin("current", "stale"), F.col("status") == "current"
    total, docs = F.coalesce(F.sum(F.when(done, F.col(weight))), F.lit(0)), _count(done)
    return items.agg(
        F.when(docs == 0, 1.0).when(total == 0, _count(fresh) / docs).otherwise(F.coalesce(F.sum(F.when(fresh, F.col(weight))), F.lit(0)) / total).alias("weighted_freshness")
    )


def needs_attention(status: Column, smelly: Column) -> Column:
    return (status != "current") | smelly


def cutoff(items: DataFrame, weight: str = "fan_in") -> Column:
    """The weight from which a file counts as shared: the 8th highest of at least 3, and no less than 3."""
    top = items.where(F.col(weight) >= SHARED_LEAST).orderBy(F.desc(weight)).limit(SHARED_RANK)  # eight rows
    return top.agg(F.greatest(F.lit(SHARED_LEAST), F.when(F.count("*") == SHARED_RANK, F.min(weight)).otherwise(F.lit(SHARED_LEAST))).alias("cutoff"))


def prioritize(items: DataFrame, weight: str = "fan_in") -> DataFrame:
    """Pending items with tier and urgency: shared code 0, features 1, files 2, rollups 3, tests 5, system 6."""
    limit = cutoff(items.where("kind = 'file' AND role = 'domain'"), weight)  # one row
    pending = items.where(needs_attention(F.col("status"), F.col("smelly"))).crossJoin(F.broadcast(limit))
    tier = (
        F.when(F.col("kind") == "system", 6)
        .when(F.col("role") == "test", 5)
        .when(F.col("kind") == "rollup", 3)
        .when(F.col("kind") == "feature", 1)
        .when(F.col(weight) >= F.col("cutoff"), 0)
        .otherwise(2)
    )
    urgency = F.when(F.col("status") == "missing", 0).when(F.col("status") == "stale", 1).otherwise(2)
    return pending.withColumn("tier", tier).withColumn("urgency", urgency).drop("cutoff")


def page(pending: DataFrame, cursor: int = 0, size: int = PAGE) -> DataFrame:
    """One page in the order of work; a total order, so pages never overlap."""
    return pending.orderBy("tier", "urgency", F.desc("fan_in"), "id").offset(cursor).limit(size)


def top_stale(items: DataFrame, n: int = TOP_STALE) -> DataFrame:
    pending = items.where((F.col("kind") == "file") & needs_attention(F.col("status"), F.col("smelly")))
    return pending.orderBy(F.desc("fan_in"), "id").limit(n)


def coverage_report(items: DataFrame, module: str = "module") -> DataFrame:
    """All sums in one pass: per kind, per module and overall (level, name, sums, ratios)."""
    grouped = items.groupingSets([[F.col("kind")], [F.col(module)], []], F.col("kind"), F.col(module)).agg(F.grouping("kind").alias("gk"), F.grouping(module).alias("gm"), *sums())
    level = F.when(F.col("gk") == 0, "kind").when(F.col("gm") == 0, "module").otherwise("all")
    return with_ratios(grouped.select(level.alias("level"), F.coalesce("kind", module, F.lit("")).alias("name"), "current", "stale", "missing", "smelly", "total"))
