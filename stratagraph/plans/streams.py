"""Watch family: user events as file events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import reports as R
from stratagraph.plans.registry import Tables, query
from stratagraph.staging import transient
from stratagraph.streaming import sessions as W


@query(
    "st2_debounce_sessions",
    """WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM r GROUP BY user_id, run""",
)
def st2(t: Tables) -> DataFrame:
    runs = W.debounce_batch(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 6 * 3600)
    return runs.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("st3_last_state", "SELECT user_id, arg_max(event_type, {'t': ts, 'e': event_type}) AS event_type, arg_max(value, {'t': ts, 'e': event_type}) AS value FROM events GROUP BY user_id")
def st3(t: Tables) -> DataFrame:
    return W.last_state(t.events, "user_id", "ts", "event_type", "value")


@query("st1_path_sets", "SELECT user_id, CAST(ts AS DATE)::VARCHAR AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY ALL")
def st1(t: Tables) -> DataFrame:
    return R.event_sets(t.events, ["user_id", F.col("ts").cast("date").cast("string").alias("day")], "event_type")


@query(
    "st5_incremental_merge",
    """WITH old AS (SELECT doc_id AS file, sha256(text) AS source_hash FROM documents WHERE doc_id % 5 <> 0),
batch AS (SELECT doc_id AS file, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS source_hash FROM documents WHERE doc_id % 2 = 0),
moved AS (SELECT b.* FROM batch b LEFT JOIN old o USING (file) WHERE b.source_hash IS DISTINCT FROM o.source_hash)
SELECT * FROM old WHERE file NOT IN (SELECT file FROM moved) UNION ALL SELECT * FROM moved WHERE source_hash IS NOT NULL""",
)
def st5(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("file"), "text")
    old = d.where("file % 5 <> 0").select("file", F.sha2("text", 256).alias("source_hash"))
    changed = F.when(F.col("file") % 7 == 0, None).when(F.col("file") % 3 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256))
    return W.merge(old, d.where("file % 2 = 0").select("file", changed.alias("source_hash")))[0]


@query(
    "st6_snapshot_update",
    """SELECT o_orderkey, CASE WHEN o_orderdate >= DATE '1998-01-01' AND o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS state
FROM orders WHERE NOT coalesce(o_orderdate >= DATE '1998-01-01' AND o_orderpriority = '5-LOW', FALSE)""",
)
def st6(t: Tables) -> DataFrame:
    """A second version over the first: the year's urgent orders change, its low ones go; read from the buckets of both."""
    now = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("state"))
    late = t.orders.where("o_orderdate >= DATE '1998-01-01' AND o_orderpriority IN ('1-URGENT', '5-LOW')")
    batch = late.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "X").alias("state"))
    held = W.Snapshots(transient(t.spark))
    held.publish({"orders": now}, "o_orderkey", buckets=16)
    held.update("orders", batch, lambda old: W.merge(old, batch, "o_orderkey", "state")[0])
    return held.read(t.spark, "orders")
