"""Window and order family: declaration order, argmax, percentiles, first pending unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import reports as R
from stratagraph.operators import search as S
from stratagraph.plans.registry import Tables, query


@query(
    "w09_largest_share",
    """WITH s AS (SELECT conv_id, arg_max(turn, {'b': strlen(text), 'o': -turn}) AS turn, max(strlen(text)) AS big, sum(strlen(text)) AS every FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, least(100, CASE WHEN every = 0 THEN 0 ELSE big * 100 // every END)::INT AS percent FROM s""",
)
def w09(t: Tables) -> DataFrame:
    """The largest part of each file, the first of equals, and its share."""
    return R.largest_part(t.conversations, "conv_id", "turn", F.octet_length("text"))


@query("w10_declaration_order", "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS members FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY 1")
def w10(t: Tables) -> DataFrame:
    """Members in source order, without those that are gone."""
    live = t.part.where("p_size <= 45").select(F.col("p_partkey").alias("l_partkey"))
    own = R.members_in_order(t.lineitem, live, "l_orderkey", "l_partkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return own.select("l_orderkey", F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r.l_linenumber, r.l_partkey)), " ").alias("members"))


@query(
    "w11_first_pending",
    "SELECT conv_id, arg_min(role, turn) AS role, min(turn) AS turn FROM conversations WHERE role <> 'system' AND length(text) > 60 GROUP BY conv_id",
)
def w11(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", "role", "text")
    return S.first_pending(rows, "conv_id", ["turn"], (F.col("role") != "system") & (F.length("text") > 60)).select("conv_id", "role", "turn")


@query(
    "a26_percentiles",
    """WITH s AS (SELECT lang, list_sort(list(n_chars)) AS x FROM documents GROUP BY lang)
SELECT lang, x[(round((len(x) - 1) * 0.5) + 1)::INT] AS p50, x[(round((len(x) - 1) * 0.9) + 1)::INT] AS p90, x[(round((len(x) - 1) * 0.99) + 1)::INT] AS p99 FROM s""",
)
def a26(t: Tables) -> DataFrame:
    """Nearest rank, exact: values are counted first, so a window sees a row per distinct value and language."""
    return R.nearest_ranks(t.documents, "lang", "n_chars", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query(
    "a26_price_percentiles",
    """WITH s AS (SELECT o_orderstatus, list_sort(list(o_totalprice)) AS x FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1)
SELECT o_orderstatus, x[(round((len(x) - 1) * 0.1) + 1)::INT] AS p10, x[(round((len(x) - 1) * 0.5) + 1)::INT] AS p50, x[(round((len(x) - 1) * 0.99) + 1)::INT] AS p99 FROM s""",
)
def a26_price(t: Tables) -> DataFrame:
    """Values of which nearly all are distinct."""
    return R.nearest_ranks(t.orders, "o_orderstatus", "o_totalprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99})


@query("a23_identical_dependencies", "WITH d AS (SELECT conv_id, role, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS deps FROM conversations GROUP BY ALL) SELECT conv_id, count(*) >= 2 AND count(DISTINCT deps) = 1 AS identical FROM d GROUP BY conv_id")
def a23(t: Tables) -> DataFrame:
    return R.identical_sets(t.conversations, "conv_id", "role", "turn")


@query("a24_outcome_report", "SELECT count(*) FILTER (l_returnflag = 'R') AS paired, count(*) FILTER (l_returnflag = 'A') AS free, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS ambiguous, count(*) FILTER (l_returnflag = 'N' AND l_linestatus <> 'O') AS unmatched FROM lineitem")
def a24(t: Tables) -> DataFrame:
    tests = {"paired": "l_returnflag = 'R'", "free": "l_returnflag = 'A'", "ambiguous": "l_returnflag = 'N' AND l_linestatus = 'O'", "unmatched": "l_returnflag = 'N' AND l_linestatus <> 'O'"}
    return R.outcomes(t.lineitem, {name: F.expr(test) for name, test in tests.items()})


@query("l07_edge_order", "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord FROM lineitem")
def l07(t: Tables) -> DataFrame:
    return R.edge_order(t.lineitem, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("l_orderkey", "l_partkey", "ord")
