"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import staged, unstage


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of 64-bit nodes to ``(node, root)`` for every node with an edge.

    root is the smallest node of the component. Self edges, repeats and either direction
    are allowed; rows with a null end are ignored. Every round is two min-aggregations
    (combined before the shuffle) and two joins on the node; rounds grow as the logarithm
    of the longest chain. Nothing but a row count and a checksum reaches the driver.
    """
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges"
    )
    mark = _signature(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Stored, so that the join on a node with a large share of all edges can be split.
        low = staged(both.groupBy("v").agg(F.min("u").alias("lo")).select("v", F.least("v", "lo").alias("lo")), "low")
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("lo").alias("u")).distinct()
        low_before, low = low, large.groupBy("v").agg(F.min("u").alias("lo"))
        small = (
            large.join(low, "v")
            .select(F.explode(F.array(F.struct("v", F.col("lo").alias("u")), F.struct(F.col("u").alias("v"), F.col("lo").alias("u")))).alias("e"))
            .select("e.*")
            .where("v <> u")
            .distinct()
        )
        last, now = now, staged(small, "stars")
        for done in (last, low_before):  # the round before is in no later plan
            unstage(done)
        before, mark = mark, _signature(now)
        if before == mark:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    )
