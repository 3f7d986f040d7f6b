"""Ranked lexical search over a tiered index: high-impact postings first, lower tiers only where they are needed.

A posting's impact is the part of a term's score that does not depend on the item: it grows with the term's count in
the document and falls with the document's length. Each term's postings are cut into three tiers by falling impact:
the first has the top 1/32 of them (128 at least, so that rare terms lie in it whole), the first two the top 1/8.

* The index has a row per block of documents and columns per tier, so that a search of the first tier reads only
  that tier's columns.
* After a tier each item has lower bounds (what its documents have been seen to score) and a residual bound: the
  sum, over its terms, of the largest impact that lies in lower tiers. Where the tenth best lower bound is above the
  residual bound, no unseen document can enter: the seen ones whose upper bound reaches the tenth are looked up in
  full, and the item is done. Items without that proof fall through to the next tier; after the last nothing is left.
* Best documents are kept per task, ten an item, so what meets to be ranked grows with tasks, not with documents.

Items are searched in groups of at most ``GROUP_BYTES`` of text (a longer item is a group of its own); what the tasks
are sent is the group's items and terms, and the index has the terms of a group only.

Defined results: a null text has no terms, and such a document counts nowhere; each row of items is an item of its
own; each row of documents is a document of its own, a null id counts as the largest; an item without terms, or an
empty table, gives no rows; further columns are ignored. Ids must be integers.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm.common import bounded_batches, staged

TOP, TIERS = 10, 3
#: Share of a term's postings, and least number of them, in the first tier and in the first two.
SHARES, LEAST = (32, 8), (128, 1024)
#: Bytes of item texts that are searched at once.
GROUP_BYTES = 4 << 20
#: Impacts are below a million; a term's cuts lie between buckets of this many bits.
BUCKET_BITS = 14
_LAST = (1 << 63) - 1
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and characters outside ASCII."""
    return text.translate(_TABLE).split()


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """The item-independent part of a score; 64-bit integers throughout."""
    m = 25 + (75 * n * docs) // max(1, length)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _forward(vocabulary):
    """Per document: its number of terms, and the known ones with their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            sizes, ids, counts = [], [], []
            for t in batch.column("text"):
                found = terms((t.as_py() or "").encode())
                own = {known[w]: c for w, c in Counter(found).items() if w in known}
                sizes.append(len(found))
                ids.append(np.fromiter(own.keys(), np.int32, len(own)))
                counts.append(np.fromiter(own.values(), np.int32, len(own)))
            name = uuid.uuid4().int >> 65
            rows = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * rows, pa.int64()), pa.array(range(rows), pa.int32()), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                names=["batch", "at", "id", "n", "terms", "counts"],
            )

    return work


def _flat(batch: pa.RecordBatch, docs: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, impact) of every posting of a batch."""
    lists, n = batch.column("terms"), batch.column("n").to_numpy()
    row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
    return row, lists.flatten().to_numpy(), impacts(batch.column("counts").flatten().to_numpy().astype(np.int64), n[row], docs, length)


def _histogram(docs: int, length: int):
    """Per batch and term: postings and the largest impact by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, term, impact = _flat(batch, docs, length)
            order = np.lexsort((impact, term))
            term, impact = term[order].astype(np.int64), impact[order]
            key = term << 32 | impact >> BUCKET_BITS
            ends = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) if len(key) else np.empty(0, np.int64)
            count = np.diff(np.concatenate([[-1], ends]))
            yield pa.RecordBatch.from_arrays([pa.array(term[ends]), pa.array(impact[ends] >> BUCKET_BITS), pa.array(count), pa.array(impact[ends])], names=["term", "bucket", "c", "top"])

    return work


def _tiers(forward: DataFrame, docs: int, length: int) -> DataFrame:
    """Per term: its documents, the lowest bucket of each upper tier, and the largest impact below that tier."""
    h = forward.mapInArrow(_histogram(docs, length), "term long, bucket long, c long, top long").groupBy("term", "bucket").agg(F.sum("c").alias("c"), F.max("top").alias("top"))
    every = Window.partitionBy("term")  # a term has at most 62 buckets
    before = F.coalesce(F.sum("c").over(every.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    h = h.select("term", "bucket", "top", "c", before.alias("before"), F.sum("c").over(every).alias("df"))
    tier = F.lit(len(SHARES))
    for k in reversed(range(len(SHARES))):
        tier = F.when(F.col("before") < F.greatest(F.lit(LEAST[k]), F.col("df") / SHARES[k]), k).otherwise(tier)
    h = h.withColumn("tier", tier)
    cuts = [F.min(F.when(F.col("tier") <= k, F.col("bucket"))).alias(f"cut{k}") for k in range(len(SHARES))]
    left = [F.coalesce(F.max(F.when(F.col("tier") > k, F.col("top"))), F.lit(0)).alias(f"left{k}") for k in range(len(SHARES))]
    return h.groupBy("term").agg(F.sum("c").alias("df"), *cuts, *left)


_PARTS = ("terms", "ends", "docs", "impacts")


def _blocks(shared, docs: int, length: int):
    """Per batch of documents: its postings by tier and term, and the name of every row: a batch read again may hold rows of several written ones."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value
        for batch in batches:
            row, term, impact = _flat(batch, docs, length)
            bucket = impact >> BUCKET_BITS
            tier = np.zeros(len(row), np.int64)
            for cut in cuts:
                tier += bucket < cut[term]
            columns = [pa.array([batch.column(c).to_numpy().astype(kind).tobytes()], pa.binary()) for c, kind in (("id", np.int64), ("batch", np.int64), ("at", np.int32))]
            for k in range(TIERS):
                own = np.flatnonzero(tier == k)
                own = own[np.argsort(term[own], kind="stable")]
                there, first = np.unique(term[own], return_index=True)
                ends = np.append(first, len(own))
                for values, kind in ((there, np.int32), (ends, np.int32), (row[own], np.int32), (impact[own], np.int32)):
                    columns.append(pa.array([values.astype(kind).tobytes()], pa.binary()))
            if len(batch):
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "batches", "ats", *[f"{p}{k}" for k in range(TIERS) for p in _PARTS]])

    return work


def _scores(batch: pa.RecordBatch, k: int, tiers: int, items: list, left: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(item, score seen, residual bound of the terms seen) of every document of a block, over the first ``tiers`` tiers."""
    n = len(batch.column("ids")[k].as_py()) // 8
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for t in range(tiers):
        there, ends, docs, impact = (np.frombuffer(batch.column(f"{p}{t}")[k].as_py(), np.int32) for p in _PARTS)
        impact = impact.astype(np.int64)
        ends = ends.tolist()
        for at, term in enumerate(there.tolist()):
            found.setdefault(term, []).append((docs[ends[at] : ends[at + 1]], impact[ends[at] : ends[at + 1]]))
    for item, weights in items:
        seen, bound = np.zeros(n, np.int64), np.zeros(n if left is not None else 0, np.int64)
        for term, w in weights:
            for docs, impact in found.get(term, ()):
                seen[docs] += w * impact
                if left is not None:
                    bound[docs] += w * left[term]
        yield item, seen, bound


def _best(shared, tiers: int):
    """Per task and item: the ten documents with the highest score seen, the smallest id first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best = {i: (np.empty(0, np.int64), np.empty(0, np.int64)) for i, _ in items}
        for batch in batches:
            for k in range(len(batch)):
                ids = np.frombuffer(batch.column("ids")[k].as_py(), np.int64)
                for item, seen, _ in _scores(batch, k, tiers, items, None):
                    scores, own = best[item]
                    hits = np.flatnonzero(seen >= (scores[-1] if len(scores) == TOP else 1))
                    if len(hits):
                        scores, own = np.concatenate([scores, seen[hits]]), np.concatenate([own, ids[hits]])
                        order = np.lexsort((own, -scores))[:TOP]
                        best[item] = scores[order], own[order]
        if best:
            item = np.concatenate([np.full(len(s), i, np.int64) for i, (s, _) in best.items()])
            scores, own = (np.concatenate([b[x] for b in best.values()]) for x in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(own), pa.array(scores)], names=["item", "id", "score"])

    return work


def _hopeful(shared, tiers: int):
    """Documents whose upper bound reaches the tenth best lower bound of a proven item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least, total, left = shared.value
        for batch in batches:
            for k in range(len(batch)):
                names, ats = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in (("batches", np.int64), ("ats", np.int32)))
                for item, seen, bound in _scores(batch, k, tiers, items, left):
                    own = np.flatnonzero((seen > 0) & (seen + total[item] - bound >= least[item]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), item, np.int64)), pa.array(names[own]), pa.array(ats[own])], names=["item", "batch", "at"])

    return work


def _looked_up(shared, docs: int, length: int):
    """The whole scores of documents that were looked up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = {i: dict(weights) for i, weights in shared.value}
        for batch in batches:
            row, term, impact = _flat(batch, docs, length)
            item = batch.column("item").to_numpy()
            score = np.zeros(len(batch), np.int64)
            w = np.fromiter((items[i].get(t, 0) for i, t in zip(item[row].tolist(), term.tolist(), strict=True)), np.int64, len(row))
            np.add.at(score, row, w * impact)
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("id"), pa.array(score)], names=["item", "id", "score"])

    return work


def _ranked(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


class Index:
    """The tiers of all documents over the terms of some items."""

    def __init__(self, documents: DataFrame, vocabulary: dict[bytes, int]):
        """documents(id, text); at most one vocabulary of a group's size is sent to the tasks."""
        spark = documents.sparkSession
        self.spark = spark
        words = spark.sparkContext.broadcast(vocabulary)
        self.forward = staged(documents.mapInArrow(_forward(words), "batch long, at int, id long, n long, terms array<int>, counts array<int>"), "forward")
        total = self.forward.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("length")).first()
        self.docs, self.length = total.docs, total.length or 0
        size = max(len(vocabulary), 1)
        self.df = np.zeros(size, np.int64)
        cuts = np.zeros((len(SHARES), size), np.int64)
        self.left = np.zeros((TIERS, size), np.int64)  # none is left below the last tier
        for r in _tiers(self.forward, self.docs, self.length).collect():  # a row per term of the group
            self.df[r.term] = r.df
            for k in range(len(SHARES)):
                cuts[k, r.term], self.left[k, r.term] = r[f"cut{k}"], r[f"left{k}"]
        columns = ", ".join(f"{p}{k} binary" for k in range(TIERS) for p in _PARTS)
        self.blocks = staged(self.forward.mapInArrow(_blocks(spark.sparkContext.broadcast(cuts), self.docs, self.length), f"ids binary, batches binary, ats binary, {columns}"), "tiers")

    def weights(self, counts: dict[int, int]) -> list[tuple[int, int]]:
        """(term, weight times repeats) of an item's terms that some document holds."""
        w = {t: math.floor(1000 * math.log((2 * self.docs + 2) / (2 * int(self.df[t]) + 1))) for t in counts if self.df[t]}
        return [(t, w[t] * counts[t]) for t in w]

    def _tier(self, tiers: int, *also: str) -> DataFrame:
        return self.blocks.select("ids", *also, *[f"{p}{k}" for k in range(tiers) for p in _PARTS])

    def search(self, items: list[tuple[int, list[tuple[int, int]]]], proven_at: dict[int, int] | None = None) -> DataFrame:
        """``(item, id, score, rank)``; ``proven_at`` receives the tiers that each item needed."""
        share = self.spark.sparkContext.broadcast
        pending, parts = [x for x in items if x[1]], []
        for tiers in range(1, TIERS + 1):
            if not pending:
                break
            best = staged(self._tier(tiers).mapInArrow(_best(share(pending), tiers), "item long, id long, score long"), "best")
            total = {i: int(sum(w * self.left[tiers - 1, t] for t, w in weights)) for i, weights in pending}
            tenth = {r.item: r.score for r in _ranked(best).where(F.col("rank") == TOP).select("item", "score").collect()}  # a row per item of the group
            whole = {i for i, _ in pending if total[i] == 0}  # no posting is left: what was seen is exact
            proven = {i for i, _ in pending if i not in whole and tenth.get(i, 0) > total[i]}
            if whole:
                parts.append(_ranked(best.join(F.broadcast(self._names(whole)), "item", "left_semi")))
            if proven:
                own = [x for x in pending if x[0] in proven]
                found = self._tier(tiers, "batches", "ats").mapInArrow(_hopeful(share((own, tenth, total, self.left[tiers - 1])), tiers), "item long, batch long, at int")
                asked = staged(found, "hopeful").join(self.forward, ["batch", "at"]).select("item", "id", "n", "terms", "counts")
                parts.append(_ranked(asked.mapInArrow(_looked_up(share(own), self.docs, self.length), "item long, id long, score long")))
            if proven_at is not None:
                proven_at.update(dict.fromkeys(whole | proven, tiers))
            pending = [x for x in pending if x[0] not in whole | proven]
        out = self.spark.createDataFrame([], "item long, id long, score long, rank int")
        for p in parts:
            out = out.unionByName(p)
        return out

    def _names(self, items: set[int]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in sorted(items)], "item long")  # at most the items of a group


def _groups(items: DataFrame, most: int) -> list[DataFrame]:
    """The items in groups of at most ``most`` bytes each, or of one item."""
    sized = items.withColumn("bytes", F.octet_length("text"))
    n = max(1, math.ceil((sized.agg(F.sum("bytes")).first()[0] or 0) / most * 2))
    while True:
        part = sized.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        if n == 1 or part.groupBy("part").agg(F.sum("bytes").alias("b"), F.count_distinct("item_id", "text").alias("c")).where((F.col("b") > most) & (F.col("c") > 1)).isEmpty():
            return [part.where(F.col("part") == k).select("item_id", "text") for k in range(n)]
        n *= 2


def search(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", most: int = GROUP_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's ten best documents of score above 0, equal scores by id."""
    spark = documents.sparkSession
    bounded_batches(spark)
    docs = documents.select(F.coalesce(F.col(f"`{doc_col}`").cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in _groups(asked, most):
        rows = group.collect()  # at most GROUP_BYTES of text, or one item
        counts = [Counter(terms(r.text.encode())) for r in rows]
        vocabulary = {w: k for k, w in enumerate(sorted(set().union(*counts)))}
        if not vocabulary:
            continue
        index = Index(docs, vocabulary)
        wanted = [(k, index.weights({vocabulary[w]: n for w, n in c.items()})) for k, c in enumerate(counts)]
        names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(rows)], "item long, item_id long")
        found = index.search(wanted).join(F.broadcast(names), "item")
        out = out.unionByName(found.select("item_id", "rank", F.nullif("id", F.lit(_LAST)).alias("doc_id"), "score"))
    return out
