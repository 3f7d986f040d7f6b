"""What joins a node is hashed whole; near pairs need no labels."""

import hashlib

from pyspark.sql import functions as F
from stratagraph.operators import pairing, reachability


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_a_node_takes_all_parts_in_order_with_repeats(spark):
    nodes = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", None)], "id string, parent string").withColumn("hash", F.sha2("id", 256))
    parts = [("a", sha(str(k % 700))) for k in range(900)] + [("b", sha("x")), ("b", sha("x")), (None, sha("y"))]
    got = {r.id: r.hash for r in pairing.absorbed(nodes, spark.createDataFrame(parts, "target string, hash string")).collect()}
    below = {"r": ("a", "b"), "a": ("a",), "b": ("b",)}
    want = {i: sha("\n".join([sha(i), *sorted(h for t, h in parts if t in own)])) for i, own in below.items()}
    assert got == want | {"c": sha("c")}


def test_pairs_that_edges_settle_make_no_labels(spark):
    edges = spark.createDataFrame([(f"s{k}", f"h{k}") for k in range(50)], "a string, b string")
    index = reachability.over(edges, small=2)
    asked = spark.createDataFrame([(f"s{k}", f"h{k}") for k in range(0, 50, 5)] + [("s1", "h2"), ("h1", "s1"), ("s1", "decoy")], "x string, y string")
    assert sorted(r.x for r in index.among(asked, "x", "y").collect()) == sorted(f"s{k}" for k in range(0, 50, 5))
    assert "labels" not in vars(index)
