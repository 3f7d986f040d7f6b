"""Substring dedup behind a count-min sketch: words covered by a window of words that stands earlier too go.

A window is 20 consecutive words of one document. It is *later* where the same words start earlier: in a document of
smaller id, or earlier in the same one. The words that later windows cover are removed.

1. Whole copies collapse: of rows with the same words only the first (smallest id) has windows that can be first.
2. Every batch of documents makes a sketch of its windows. A window is counted at its rarest-looking run of 8 words
   (the smallest hash, the first of equals), so that neighbours that share the run count once: windows that are
   equal have equal runs, so a slot's count never is less than its windows'. A sketch has ``DEPTH`` rows of counters,
   cut into ranges of ``2 ** SLICE_BITS`` counters; a batch's part of a range is the list of the slots it hits.
3. The ranges are merged: the batches' counts add up, and each batch learns which of its slots reach two. The
   least of the rows counts. Rows are as wide as four times the words, so that the sketch grows with the input, and
   no task or driver holds more than a range of it.
4. The second pass emits the windows whose estimate is two or more, those that stand in one batch several times
   once, and groups them exactly (by 128 bits of hash). An estimate is never too low, so no repeated window is lost;
   one that is too high only costs a row.

A hot passage is a row a batch (up to 2,048 documents), so its rows are sorted in one task without harm.

Defined results: a null text has no words; a null id counts as the largest; rows of equal id are ordered by the
start alone, and of windows with equal (id, start) all are first; repeated rows each get a row; an empty table gives
no rows; further columns are ignored. ``doc_id`` must be an integer.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm.common import bounded_batches, staged, unstage

WINDOW, RUN = 20, 8
#: Rows of the sketch, counters in a range of a row, and counters a word.
DEPTH, SLICE_BITS, PER_WORD = 2, 22, 4
_MASK = (1 << 64) - 1
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_LAST = (1 << 63) - 1


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def _rolled(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of each ``width`` consecutive word hashes, by doubling: polynomials modulo 2 ** 64."""
    out, have, left = None, 0, width
    part, size, power = words, 1, base & _MASK
    while left:
        if left & 1:  # the parts from the shortest to the longest
            n = len(words) - (have + size) + 1
            out = part[:n] if out is None else out[:n] * np.uint64(power) + part[have : have + n]
            have += size
        left >>= 1
        if left:
            n = len(part) - size
            part = part[:n] * np.uint64(power) + part[size : size + n] if n > 0 else part[:0]
            size, power = 2 * size, power * power & _MASK
    return out


class Batch:
    """The windows of some documents: where each starts, its run of words, and its hash."""

    def __init__(self, texts: list[bytes]):
        import xxhash

        hashed = [b"".join(map(xxhash.xxh64_digest, t.split())) for t in texts]
        self.sizes = np.array([len(w) // 8 for w in hashed], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.frombuffer(b"".join(hashed), ">u8").astype(np.uint64)
        del hashed
        per = np.maximum(self.sizes - WINDOW + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), per)
        self.start = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)  # within its document
        self.at = self.first[self.doc] + self.start  # in the batch

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, hash) of the run that each window is counted at."""
        if not len(self.at):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        grams = _mixed(_rolled(self.words, RUN, _BASE[0]), _BASE[1])
        low = (grams & np.uint64(0xFFFFFFFF00000000)) >> np.uint64(1) | np.arange(len(grams), dtype=np.uint64)  # the smallest, of equals the first
        span = WINDOW - RUN + 1  # 13 = 8 + 5
        for step in (1, 2, 4):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: len(low) - (span - 8)], low[span - 8 :])
        place = (low[self.at] & np.uint64(0x7FFFFFFF)).astype(np.int64)
        return place, grams[place]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each window."""
        one = _rolled(self.words, WINDOW, _BASE[0])
        two = _rolled(_mixed(self.words, _BASE[0]), WINDOW, _BASE[1])
        return one[self.at], two[self.at]


def slots(runs: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The counter of each run in every row of the sketch."""
    for row in range(DEPTH):
        yield _mixed(runs, _BASE[row]) >> np.uint64(64 - bits)


def sketch_bits(words: int) -> int:
    """Bits of a slot: a row has ``PER_WORD`` counters a word at least, and a range's worth."""
    return max(SLICE_BITS, int(max(1, words) * PER_WORD - 1).bit_length())


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in batch.column("text")]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its number of words, and 128 bits of them."""
    for batch in batches:
        sizes, ones, twos = [], [], []
        for t in _texts(batch):
            words = t.split()
            digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
            sizes.append(len(words))
            ones.append(int.from_bytes(digest[:8], "big", signed=True))
            twos.append(int.from_bytes(digest[8:], "big", signed=True))
        columns = [batch.column("id"), batch.column("h"), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "n", "w1", "w2"])


def _sketches(bits: int, cut: int):
    """Per batch: its documents (row -1), and per row and range of the sketch the slots hit, with the document of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, name = Batch(_texts(batch)), uuid.uuid4().int >> 65  # at most 2,048 documents
            place, runs = own.runs()
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (own.doc[1:] != own.doc[:-1])])[: len(place)]  # windows that share a run count once
            docs, runs = own.doc[new], runs[new]
            rows, ranges = [-1], [0]
            hits = [np.stack([batch.column("id").to_numpy(), batch.column("h").to_numpy()], 1).tobytes()]
            of = [b""]
            for row, slot in enumerate(slots(runs, bits)):
                order = np.argsort(slot, kind="stable")
                slot, held = slot[order], docs[order].astype(np.uint16)
                part = slot >> np.uint64(cut)
                low = (slot & np.uint64((1 << cut) - 1)).astype(np.uint32)
                for lo, hi in _groups(part):
                    rows.append(row)
                    ranges.append(int(part[lo]))
                    hits.append(low[lo:hi].tobytes())
                    of.append(held[lo:hi].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows)), pa.array(rows, pa.int32()), pa.array(ranges, pa.int64()), pa.array(hits, pa.binary()), pa.array(of, pa.binary())], names=["batch", "row", "range", "slots", "doc"]
            )

    return work


def _groups(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_keys):
        cuts = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_keys)], strict=True)


def _merged(cut: int):
    """The counters of one range, summed over the batches: per batch its slots that reach two."""

    def work(table: pa.Table) -> pa.Table:
        counts = np.zeros(1 << cut, np.uint8)  # 0, 1, 2 or more
        for b in table.column("slots"):
            once, n = np.unique(np.frombuffer(b.as_py(), np.uint32), return_counts=True)
            counts[once] = np.minimum(counts[once] + np.minimum(n, 2), 2)
        base, keep, hits, of = table.column("range")[0].as_py() << cut, [], [], []
        for k, (b, d) in enumerate(zip(table.column("slots"), table.column("doc"), strict=True)):
            own = np.frombuffer(b.as_py(), np.uint32)
            heavy = counts[own] > 1
            if heavy.any():
                keep.append(k)
                hits.append((own[heavy].astype(np.int64) + base).tobytes())
                of.append(np.frombuffer(d.as_py(), np.uint16)[heavy].tobytes())
        rows = table.select(["batch", "row"]).take(pa.array(keep, pa.int64()))
        return pa.table({"batch": rows["batch"], "row": rows["row"], "slots": pa.array(hits, pa.binary()), "doc": pa.array(of, pa.binary())})

    return work


def _named(table: pa.Table) -> pa.Table:
    """What the ranges told one batch: per document that has any, its slots that reach two, by row."""
    docs, told = np.empty((0, 2), np.int64), [[(np.empty(0, np.int64), np.empty(0, np.uint16))] for _ in range(DEPTH)]
    for row, b, d in zip(table.column("row").to_pylist(), table.column("slots"), table.column("doc"), strict=True):
        if row < 0:
            docs = np.frombuffer(b.as_py(), np.int64).reshape(-1, 2)
        else:
            told[row].append((np.frombuffer(b.as_py(), np.int64), np.frombuffer(d.as_py(), np.uint16)))
    lists = []
    for own in told:
        hits, of = np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])
        order = np.argsort(of, kind="stable")
        hits, of = hits[order], of[order]
        lists.append({int(of[lo]): np.unique(hits[lo:hi]).tobytes() for lo, hi in _groups(of)})
    both = sorted(set(lists[0]).intersection(*lists[1:]))
    return pa.table({"id": pa.array(docs[both, 0]), "h": pa.array(docs[both, 1]), **{f"heavy{r}": pa.array([lists[r][k] for k in both], pa.binary()) for r in range(DEPTH)}})


CANDIDATES = "id long, h long, w1 long, w2 long, start int, starts array<int>"


def _candidates(bits: int):
    """Windows estimated twice or more: the first of a batch to be grouped, the starts of its later ones at once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Batch(_texts(batch))
            ids, hs = batch.column("id").to_numpy(), batch.column("h").to_numpy()
            _, runs = own.runs()
            good = np.ones(len(runs), bool)
            for row, slot in enumerate(slots(runs, bits)):
                heavy = [np.frombuffer(b.as_py(), np.int64) for b in batch.column(f"heavy{row}")]
                good &= np.isin(slot.astype(np.int64), np.unique(np.concatenate([np.empty(0, np.int64), *heavy])))
            if not good.any():
                continue
            one, two = (x[good].view(np.int64) for x in own.hashes())
            doc, start = own.doc[good], own.start[good]
            order = np.lexsort((start, ids[doc], two, one))
            one, two, doc, start = one[order], two[order], doc[order], start[order]
            same = np.concatenate([[False], (one[1:] == one[:-1]) & (two[1:] == two[:-1])])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(one))))
            later = same & ((ids[doc] != ids[doc[head]]) | (start != start[head]))
            k = np.flatnonzero(~later)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[doc[k]]), pa.array(hs[doc[k]]), pa.array(one[k]), pa.array(two[k]), pa.array(start[k].astype(np.int32)), pa.nulls(len(k), pa.list_(pa.int32()))],
                names=["id", "h", "w1", "w2", "start", "starts"],
            )
            k = np.flatnonzero(later)
            k = k[np.argsort(doc[k], kind="stable")]
            parts = [(doc[k[lo]], start[k[lo:hi]].astype(np.int32)) for lo, hi in _groups(doc[k])]
            there = np.array([d for d, _ in parts], np.int64)
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[there]), pa.array(hs[there]), none, none, pa.nulls(len(parts), pa.int32()), pa.array([s for _, s in parts], pa.list_(pa.int32()))],
                names=["id", "h", "w1", "w2", "start", "starts"],
            )

    return work


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, kept = [], [], []
        for text, copy, lists in zip(_texts(batch), batch.column("copy").to_pylist(), batch.column("starts"), strict=True):
            words = text.split()
            removed = np.zeros(len(words), bool)
            if copy and len(words) >= WINDOW:
                removed[:] = True
            elif lists.is_valid:
                ends = np.zeros(len(words) + 1, np.int64)
                at = lists.values.flatten().to_numpy() if len(lists.values) else np.empty(0, np.int32)
                np.add.at(ends, at, 1)
                np.add.at(ends, at + WINDOW, -1)
                removed = np.cumsum(ends[:-1]) > 0
            sizes.append(len(words))
            gone.append(int(removed.sum()))
            kept.append((b" ".join(words[k] for k in np.flatnonzero(~removed).tolist()) if gone[-1] else b" ".join(words)).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with the key they are known by: the id (a null one is the largest) and the text's hash."""
    text: Column = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = F.col(f"`{id_col}`").cast("long")
    return df.select(own.alias("doc_id"), F.coalesce(own, F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))


def drop_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, cut: int = SLICE_BITS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` per row: the words that stay, joined by one space.

    A row of the sketch has ``2 ** bits`` counters (``sketch_bits`` of the words), in ranges of ``2 ** cut``.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = _keyed(df, id_col, text_col)
    texts = rows.select("id", "h", "text")
    prints = staged(texts.mapInArrow(_prints, "id long, h long, n long, w1 long, w2 long"), "prints")
    bits = bits or sketch_bits(prints.agg(F.sum("n")).first()[0] or 0)
    # Whole copies: the first of each list of words stands for all; of equal (id, words) each does.
    lead = staged(prints.where(F.col("n") >= WINDOW).groupBy("w1", "w2").agg(F.min("id").alias("lead"), F.count("*").alias("m")).where("m > 1"), "leads")
    copies = staged(prints.join(lead, ["w1", "w2"]).where("id > lead").select("id", "h").distinct(), "copies")
    for done in (prints, lead):  # what no later plan reads
        unstage(done)

    parts = staged(texts.mapInArrow(_sketches(bits, cut), "batch long, row int, range long, slots binary, doc binary"), "sketches")
    heavy = parts.where("row >= 0").groupBy("row", "range").applyInArrow(_merged(cut), "batch long, row int, slots binary, doc binary")
    told = heavy.unionByName(parts.where("row < 0").select("batch", "row", "slots", "doc"))
    named = told.groupBy("batch").applyInArrow(_named, "id long, h long, " + ", ".join(f"heavy{r} binary" for r in range(DEPTH)))
    named = staged(named.dropDuplicates(["id", "h"]).join(copies, ["id", "h"], "left_anti"), "heavy")
    unstage(parts)

    again = texts.join(named, ["id", "h"]).select("id", "h", "text", *[f"heavy{r}" for r in range(DEPTH)])
    cands = staged(again.mapInArrow(_candidates(bits), CANDIDATES), "windows")
    unstage(named)
    single = cands.where("start IS NOT NULL").select("id", "h", "w1", "w2", "start")
    # A window has a row a batch at most, so that sorting a window's rows needs no cut.
    place = F.rank().over(Window.partitionBy("w1", "w2").orderBy("id", "start"))
    later = single.withColumn("place", place).where("place > 1").select("id", "h", F.array("start").alias("starts"))
    spans = later.unionByName(cands.where("starts IS NOT NULL").select("id", "h", "starts")).groupBy("id", "h").agg(F.collect_list("starts").alias("starts"))
    marks = staged(spans.withColumn("copy", F.lit(False)).unionByName(copies.select("id", "h", F.lit(None).cast("array<array<int>>").alias("starts"), F.lit(True).alias("copy"))), "spans")
    out = rows.join(marks, ["id", "h"], "left").select("doc_id", "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    return out.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept string")


def digests(kept: DataFrame) -> DataFrame:
    """The contract's columns of ``drop_repeats``."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
