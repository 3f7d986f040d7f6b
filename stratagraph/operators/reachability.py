"""Which of given pairs of nodes reach each other, without the closure.

The graph is condensed to its strong components. Each of a few spanning forests, in which a node hangs below one of
its predecessors taken at random, numbers the nodes as nested intervals (``intervals``). Comparisons then decide
most pairs:

* b's interval lies in a's, in one of the forests: a reaches b.
* a and b are an edge, or no way of two edges or more can lead from a to b (none leaves the nodes after a, or enters those
  before b): this is settled first, and where it settles all pairs no label is made.
* the range of numbers that b reaches, in one of the forests, is not within the range that a reaches: a does not.

Only pairs that neither decides are searched for, from a, through nodes whose ranges still hold b's, until one is met
that has b in its interval. Tables have a row a node, an edge, or an asked pair and node on its way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import graph, intervals
from stratagraph.operators.ordered import before, dealt
from stratagraph.staging import SENT, checkpointed, chosen, dropped, observed

FORESTS = 2
#: Nodes up to which ``over`` takes the closure, 64 starts a row: at most 4,194,304 rows.
SMALL = 1 << 14


class Closure:
    """All pairs, for graphs that are small enough."""

    def __init__(self, edges: DataFrame):
        self.pairs = checkpointed(graph.reach(edges, edges.select(F.col("a").alias("start")).distinct()))

    def among(self, asked: DataFrame, a: str, b: str) -> DataFrame:
        """The distinct asked pairs in which a reaches b; a node does not reach itself."""
        own = self.pairs.select(F.col("start").alias(a), F.col("node").alias(b))
        return asked.select(a, b).distinct().join(own, [a, b], "left_semi")


class Index:
    """Labels of all nodes, and the edges between components; made when the first pair asks for them."""

    def __init__(self, edges: DataFrame, forests: int = FORESTS):
        self.own, self.forests = checkpointed(edges.select("a", "b").where("a <> b").distinct()), forests

    def __getattr__(self, name: str):
        if name not in ("of", "edges", "labels"):
            raise AttributeError(name)
        self._label(self.own, self.forests)
        return self.__dict__[name]

    def _label(self, own: DataFrame, forests: int) -> None:
        strong = checkpointed(graph.strong_components(own))
        nodes = own.select(F.col("a").alias("node")).unionByName(own.select(F.col("b").alias("node"))).distinct()
        self.of = checkpointed(nodes.join(strong, "node", "left").select("node", F.coalesce("component", "node").alias("c")))
        at = lambda x: self.of.select(F.col("node").alias(x), F.col("c").alias(f"c{x}"))
        self.edges = checkpointed(own.join(at("a"), "a").join(at("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct())
        heads = self.of.select(F.col("c").alias("id")).distinct()
        labels = heads
        for k in range(forests):
            parent = self.edges.groupBy("b").agg(F.min_by("a", F.struct(F.xxhash64("a", "b", F.lit(k)), F.col("a"))).alias("parent")).withColumnRenamed("b", "id")
            numbered = intervals.numbered(heads.join(parent, "id", "left"))
            own = self._placed(numbered, k).toDF("id", f"enter{k}", f"leave{k}", f"high{k}")  # what the forest reaches is known at once
            labels = labels.join(own.withColumn(f"low{k}", F.col(f"enter{k}")), "id")
        self.labels = self._spread(checkpointed(labels))

    @staticmethod
    def _placed(numbered: DataFrame, k: int) -> DataFrame:
        """(id, enter, leave, leave): a forest's numbers as one range of longs, its trees after one another in a random order."""
        trees = numbered.where("id = root").select("root", F.col("enter").alias("first"), (F.col("leave") - F.col("enter") + 1).alias("width"), F.xxhash64("root", F.lit(k)).alias("tree"), F.lit(0).alias("all"))
        at = before(dealt(trees, "all", ["tree", "root"]), "all", ["tree", "root"], "width", "past").select("root", (F.coalesce("past", F.lit(0)) - F.col("first")).alias("shift"))
        own = numbered.join(at, "root")
        return own.select("id", (F.col("enter") + F.col("shift")).alias("enter"), (F.col("leave") + F.col("shift")).alias("leave"), (F.col("leave") + F.col("shift")).alias("high"))

    def _spread(self, labels: DataFrame) -> DataFrame:
        """Every node's ranges widened to all that it reaches; a round an edge on the longest way that still widens.

        Only nodes that a round has widened tell those before them. What at most ``SENT`` nodes are told is kept beside
        the ranges (``late``), which are written again when more have been told.
        """
        ranges = [f"{x}{k}" for k in range(self.forests) for x in ("low", "high")]
        best = lambda c: F.min if c.startswith("low") else F.max
        pick = lambda c: F.least if c.startswith("low") else F.greatest
        marked = lambda df, p: df.select("id", *[F.col(c).alias(f"{p}_{c}") for c in ranges])
        size, most = labels.count(), self.edges.count()
        now = fresh = labels.select("id", *ranges)
        n, late, lately = size, None, 0
        while n:
            told = self.edges.join(chosen(fresh.select(F.col("id").alias("b"), *ranges), n), "b").groupBy(F.col("a").alias("id")).agg(*[best(c)(c).alias(c) for c in ranges])
            heard = most
            if most > SENT:  # else they are few in any case
                told, seen = observed(told, n=F.count("*"))
                heard = seen["n"]
            few = heard <= SENT and lately + heard <= SENT
            met = now.join(chosen(marked(told, "n"), heard), "id", "inner" if few else "left")
            known = lambda c: F.col(c)
            if late is not None:
                met = met.join(F.broadcast(marked(late, "l")), "id", "left")  # at most SENT rows
                known = lambda c: pick(c)(F.col(c), F.col(f"l_{c}"))
            moved = reduce(lambda x, y: x | y, [F.coalesce(pick(c)(known(c), F.col(f"n_{c}")) != known(c), F.lit(False)) for c in ranges])
            step = met.select("id", *[pick(c)(known(c), F.col(f"n_{c}")).alias(c) for c in ranges], moved.alias("moved"))
            new, seen = observed(step.where("moved") if few else step, n=F.count_if("moved"))
            fresh, n = new.where("moved"), seen["n"]
            if few:
                late, lately = fresh.drop("moved") if late is None else checkpointed(late.unionByName(fresh.drop("moved")).groupBy("id").agg(*[best(c)(c).alias(c) for c in ranges])), lately + n
            else:
                dropped(now)
                now, late, lately = new, None, 0
        wide = now.select("id", *ranges)
        if late is not None:
            wide = wide.join(F.broadcast(marked(late, "l")), "id", "left").select("id", *[pick(c)(F.col(c), F.col(f"l_{c}")).alias(c) for c in ranges])
        return checkpointed(labels.drop(*ranges).join(wide, "id"))

    def _named(self, prefix: str) -> DataFrame:
        return self.labels.select(*[F.col(c).alias(f"{prefix}{c}") for c in self.labels.columns])

    def _sure(self, a: str, b: str) -> Column:
        """One forest has b below a, or a is b."""
        nested = [(F.col(f"{a}enter{k}") <= F.col(f"{b}enter{k}")) & (F.col(f"{b}leave{k}") <= F.col(f"{a}leave{k}")) for k in range(self.forests)]
        return reduce(lambda x, y: x | y, nested)

    def _open(self, a: str, b: str) -> Column:
        """Every forest has b's range in a's."""
        held = [(F.col(f"{a}low{k}") <= F.col(f"{b}low{k}")) & (F.col(f"{b}high{k}") <= F.col(f"{a}high{k}")) for k in range(self.forests)]
        return reduce(lambda x, y: x & y, held)

    def among(self, asked: DataFrame, a: str, b: str) -> DataFrame:
        """The distinct asked pairs in which a reaches b; a node does not reach itself."""
        at = lambda x, c: self.of.select(F.col("node").alias(x), F.col("c").alias(c))
        pairs, n = self._far(asked.select(a, b).distinct().where(F.col(a) != F.col(b)), a, b)
        direct = asked.select(a, b).distinct().join(self.own.toDF(a, b), [a, b], "left_semi")
        if not n:
            return direct
        pairs = checkpointed(pairs.join(at(a, "ca"), a).join(at(b, "cb"), b))
        heads = pairs.select("ca", "cb").distinct().join(self._named("a_"), F.col("ca") == F.col("a_id")).join(self._named("b_"), F.col("cb") == F.col("b_id"))
        how = F.when(self._sure("a_", "b_"), "sure").when(self._open("a_", "b_"), "open")
        judged = checkpointed(heads.select("ca", "cb", how.alias("how")).where("how IS NOT NULL"))
        good = judged.where("how = 'sure'").select("ca", "cb").unionByName(self._searched(judged.where("how = 'open'").select("ca", "cb")))
        return direct.unionByName(pairs.join(good, ["ca", "cb"], "left_semi").select(a, b))

    def _far(self, pairs: DataFrame, a: str, b: str) -> tuple[DataFrame, int]:
        """Pairs that are no edge, and between whose ends a way of two edges at least may lead; and their number."""
        heads, tails = self.own.select(F.col("a").alias("_n")).distinct(), self.own.select(F.col("b").alias("_n")).distinct()
        out = self.own.join(heads, F.col("b") == F.col("_n"), "left_semi").select(F.col("a").alias(a)).distinct()
        into = self.own.join(tails, F.col("a") == F.col("_n"), "left_semi").select(F.col("b").alias(b)).distinct()
        left = pairs.join(out, a, "left_semi").join(into, b, "left_semi").join(self.own.toDF(a, b), [a, b], "left_anti")
        left, seen = observed(left, n=F.count("*"))
        return left, seen["n"]

    def _searched(self, pairs: DataFrame) -> DataFrame:
        """Of undecided pairs of components those in which one reaches the other."""
        found = pairs.where("false")
        pairs, asked = observed(pairs, n=F.count("*"))
        ends = checkpointed(self._named("b_").join(chosen(pairs.select(F.col("cb").alias("b_id")).distinct(), asked["n"]), "b_id", "left_semi"))
        now, n = observed(pairs.withColumn("at", F.col("ca")).withColumn("fresh", F.lit(True)), n=F.count("*"))
        while n["n"]:
            step = chosen(now.where("fresh"), n["n"]).join(self.edges.select(F.col("a").alias("at"), F.col("b").alias("next")), "at").select("ca", "cb", F.col("next").alias("at")).distinct()
            step = step.join(now.select("ca", "cb", "at"), ["ca", "cb", "at"], "left_anti")
            near, met = observed(step, n=F.count("*"))
            step = chosen(near, met["n"]).join(self._named("a_"), F.col("at") == F.col("a_id")).join(chosen(ends, asked["n"]), F.col("cb") == F.col("b_id")).where(self._open("a_", "b_"))
            step = checkpointed(step.select("ca", "cb", "at", self._sure("a_", "b_").alias("sure")))
            hits = checkpointed(step.where("sure").select("ca", "cb").distinct())
            found = found.unionByName(hits)
            seen = now.select("ca", "cb", "at", F.lit(False).alias("fresh")).unionByName(step.select("ca", "cb", "at", F.lit(True).alias("fresh")))
            later, n = observed(seen.join(hits, ["ca", "cb"], "left_anti"), n=F.count_if("fresh"))
            for done in (now, near, step):
                dropped(done)
            now = later
        return found


def over(edges: DataFrame, small: int = SMALL) -> Closure | Index:
    """edges(a, b) as what answers ``among``: the closure up to ``small`` nodes, which is quicker, and labels beyond."""
    own = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    nodes = own.select("a").union(own.select("b")).distinct().count()
    return Closure(own) if nodes <= small else Index(own)
