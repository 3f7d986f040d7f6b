"""SimHash near-dedup by pigeonhole blocks.

A fingerprint is cut into four blocks of 16 bits. Two fingerprints that differ in at most
two bits agree on at least two whole blocks, so each of the six block pairs is a join key
that no close pair escapes. Members of a key group are then verified by Hamming distance.

* Only distinct fingerprints enter the join: copies collapse before any key is made.
* A key group that is larger than ``MAX_GROUP`` is cut again by the same rule on the 32 bits
  the key leaves free (four blocks of 8), and again on the 16 bits left then (four blocks of
  4). After that 8 bits are free, so no group holds more than 256 distinct fingerprints:
  the split is exact, drops nothing and bounds every group whatever the data.
* A group yields a star per verified cluster (at most size - 1 rows), never its pairs.

Defined results: a null text counts as empty; a text without words has fingerprint zero and
links like any other; repeated rows each get a row; a null doc_id keeps its row and does not
name a component unless all its ids are null (then component_id is null); an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import carried, id_and_text, staged
from stratagraph.llm.graph import connected_components

SEED, WIDTH, DISTANCE = 42, 3, 2
#: Members a key group may have before it is cut by further blocks; at least 256, see above.
MAX_GROUP = 512
#: Places that the repeats of a row are dealt to first.
SALTS = 32
_SLICE, _SPACE = 1 << 20, re.compile(rb"[ \t-\r]")


def slices(text: str) -> Iterator[list[bytes]]:
    """The words of a text in slices that end at a space, so that a long text needs no list of all its words."""
    data, at = text.encode("utf-8", "surrogatepass").lower(), 0  # bytes: A-Z only
    while at < len(data):
        end = _SPACE.search(data, at + _SLICE)
        end = end.start() if end else len(data)
        yield data[at:end].split()  # the six ASCII spaces
        at = end


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    """The 64-bit fingerprint as an unsigned integer: a bit is 1 where over half the shingles' XXH64 have it."""
    import xxhash

    ones, n, words = np.zeros(64, np.int64), 0, []
    for more in slices(text):
        words += more
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
            hashes = b"".join(map(xxhash.xxh64_digest, shingles, repeat(seed)))  # big-endian
            ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            n += len(words) - width + 1
            words = words[len(words) - width + 1 :]
    if not n:  # fewer words than a shingle has: the whole sequence, or nothing
        return xxhash.xxh64_intdigest(b" ".join(words), seed) if words else 0
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py() or "") for t in batch.column("text")), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["key", "fp"])


def fingerprints(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``(key, fp)`` per row of ``df``: the named column unchanged and the fingerprint as a signed long."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints, f"key {kind}, fp long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verify each group's members by Hamming distance; a star per cluster of linked members."""
    for batch in batches:
        ends: list[np.ndarray] = [np.empty((0, 2), np.int64)]
        lists = batch.column("fps")
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            own = flat[lo:hi]
            bits = own.view(np.uint64)
            near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= DISTANCE
            left = np.ones(len(own), bool)
            while left.any():
                reached = np.zeros(len(own), bool)
                reached[np.argmax(left)] = True
                front = reached.copy()
                while front.any():
                    more = near[front].any(axis=0) & ~reached
                    reached |= more
                    front = more
                left &= ~reached
                members = own[reached]
                if len(members) > 1:
                    ends.append(np.stack([np.full(len(members) - 1, members[0]), members[1:]], axis=1))
        out = np.concatenate(ends)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])


def _block_pairs(rest: Column, bits: int) -> Column:
    """The six (pair number, agreed bits, free bits) of a value of ``bits`` bits cut into four blocks."""
    w = bits // 4
    block = [F.shiftrightunsigned(rest, w * i).bitwiseAND(F.lit((1 << w) - 1)) for i in range(4)]
    out = []
    for t, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        out.append(
            F.struct(
                F.lit(t).cast("long").alias("t"),
                F.shiftleft(block[i], w).bitwiseOR(block[j]).alias("agreed"),
                F.shiftleft(block[k], w).bitwiseOR(block[m]).alias("free"),
            )
        )
    return F.explode(F.array(*out))


def near_links(distinct: DataFrame) -> DataFrame:
    """``(a, b)`` links that connect all distinct fingerprints ``fp`` within the distance."""
    level, keys = distinct.select("fp", F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"), F.col("fp").alias("rest")), None
    links = None
    for bits in (64, 32, 16):
        cut = level.select("fp", "g1", "g2", _block_pairs(F.col("rest"), bits).alias("p"))
        if bits == 64:  # g1: pair number and 32 agreed bits; g2: those of the further levels
            g1, g2 = F.shiftleft("p.t", 32).bitwiseOR(F.col("p.agreed")), F.col("g2")
        else:
            g1, g2 = F.col("g1"), F.shiftleft("g2", 24).bitwiseOR(F.shiftleft("p.t", 16)).bitwiseOR(F.col("p.agreed"))
        keys = cut.select("fp", g1.alias("g1"), g2.alias("g2"), F.col("p.free").alias("rest"))
        sizes = keys.groupBy("g1", "g2").agg(F.count("*").alias("n")).where("n > 1")
        met = staged(keys.join(sizes, ["g1", "g2"]), f"blocks{bits}")
        small = met if bits == 16 else met.where(F.col("n") <= MAX_GROUP)
        found = small.groupBy("g1", "g2").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_forest, "a long, b long")
        links = found if links is None else links.unionByName(found)
        level = met.where(F.col("n") > MAX_GROUP).select("fp", "g1", "g2", "rest")
        if bits == 16 or level.isEmpty():
            return links
    return links


def _classes(prints: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``prints(key, fp)`` to ``(fp, first)``: the smallest key of each fingerprint's component."""
    own = prints.groupBy("fp").agg(F.min("key").alias("own"))
    nodes = connected_components(near_links(own.select("fp")) if links is None else links)
    # Stored, so that the rows of a component that holds a third of all fingerprints can be split in their join.
    linked = staged(nodes.join(own, nodes.node == own.fp).select("fp", "root", "own"), "linked")
    first = staged(linked.groupBy("root").agg(F.min("own").alias("first")), "firsts")
    linked = linked.join(first, "root").select("fp", "first")
    return own.join(linked, "fp", "left").select("fp", F.coalesce("first", "own").alias("first"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``: 16 hex digits and the smallest id reachable by links."""
    prints = staged(fingerprints(id_and_text(df, id_col, text_col), "doc_id"), "prints")
    classes = staged(_classes(prints), "classes")  # both sides of the join are plain scans: a hot fingerprint can be split
    return prints.join(classes, "fp").select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first").alias("component_id"),
    )


def by_bits(order: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``order(key, text)`` to its fingerprints ``(key, fp)``, linked within the distance."""
    return staged(fingerprints(order, "key"), "prints"), None


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", linked: Callable = by_bits) -> DataFrame:
    """``df`` with one row of each component: that of the smallest id, a null id last. Columns unchanged.

    ``linked`` says what is near: ``by_bits`` here, or ``near_copies.by_words``.
    A row is known by its id and its text's hash, so ids need not be unique; of repeated rows
    with the same id and text one stays (the first by a hash of the whole row).
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("no_id"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"))
    rows = carried(df, text_col).withColumn("key", F.struct(F.col(f"row.`{id_col}`").isNull().alias("no_id"), F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("h")))
    order = df.select(key.alias("key"), text.alias("text"))
    prints, links = linked(order)
    keep = _classes(prints, links).select(F.col("first").alias("key")).distinct()
    times = prints.groupBy("key").agg(F.count("*").alias("n"))
    keep = staged(
        keep.join(times, keep.key.eqNullSafe(times.key)).select(
            F.struct(keep.key.no_id.alias("no_id"), F.coalesce(keep.key.id.cast("string"), F.lit("")).alias("id"), keep.key.h.alias("h")).alias("key"), "n"
        ),
        "keep",
    )
    out = rows.join(keep.where("n = 1"), "key", "left_semi").select("row")
    if not (again := keep.where("n > 1")).isEmpty():
        same = rows.join(again, "key", "left_semi").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
        for by in (["key", "part"], ["key"]):  # repeats that differ in further columns combine in two steps
            same = same.groupBy(*by).agg(F.min_by("row", F.struct(F.xxhash64("row"), F.to_json("row"))).alias("row"))
        out = out.unionByName(same.select("row"))
    return out.select("row.*")
