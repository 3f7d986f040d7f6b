"""Sharding by minimax contiguous partition, with DataFrame functions only.

Equal texts form an atomic group. Groups are ordered by a 64-bit hash of their text, and that
order is cut into contiguous shards so that the largest shard is as small as it can be: a
binary search over the capacity, each candidate checked greedily.

The search runs over cells, ranges of the hash with the sum of their groups' sizes: first the
2 ** TOP_BITS ranges of the leading bits. A capacity that the cells allow is feasible for the
groups as well. Cells in which a greedy cut could fall are split by further hash bits and the
search runs again, until every cell that stops the greedy check one byte below the best
capacity is a single group. Then no finer split can help: the capacity is exact. The first round
sends 2 ** TOP_BITS sums to the driver, a further one at most MAX_CELLS * 2 ** SPLIT_BITS, at any scale.

Greedy filling to the capacity would leave shards empty where one group alone makes the capacity.
So the cuts are made level: under the same capacity, each shard ends where it comes nearest to the
mean of what is left (groups beyond the mean aside, which fill shards of their own).

A row's slot is its rank in (shard, salt) groups of bounded size plus the groups' offsets. Rows are
dealt to salts by a number fixed when they are staged, so repeats spread like other rows.

Defined results: a null text counts as empty; repeated rows each get a slot; null ids come
first within their salt; an empty table gives no rows; extra columns are ignored. A group
larger than the mean shard is a shard's lower bound: it is never divided.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm.common import id_and_text, staged

SHARDS, ROW_BYTES = 40, 16
#: Leading hash bits of the first cells, bits that a split adds, and cells a round may split.
TOP_BITS, SPLIT_BITS, MAX_CELLS = 14, 6, 1024
#: Rows of a (shard, salt) group on average.
GROUP_ROWS = 256

Cell = tuple[int, int, int, int]  # first hash value, hash bits fixed, size of its groups, number of groups


def greedy(sums: list[int], shards: int, capacity: int) -> list[int] | None:
    """Ends (in cells) of the shards if ``capacity`` suffices; ``sums[i]``: the size before cell i."""
    ends, at, last = [], 0, len(sums) - 1
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity) - 1
        ends.append(at)
    return ends if at == last else None


def level(cells: list[Cell], shards: int, capacity: int) -> list[int]:
    """Ends (in cells) of ``shards`` shards of at most ``capacity`` each, as near to equal as a pass from the left makes them."""
    sums, last = [0, *accumulate(c[2] for c in cells)], len(cells)
    least = [last]  # least[k]: the first cell from which k shards suffice
    for _ in range(shards):
        least.append(bisect_left(sums, sums[least[-1]] - capacity))
    large, mean = [], sums[-1] / shards  # indivisible cells beyond the mean of the rest
    while more := [i for i, c in enumerate(cells) if c[2] > mean and (c[3] == 1 or c[1] == 64) and i not in large]:
        large += more
        mean = (sums[-1] - sum(cells[i][2] for i in large)) / max(1, shards - len(large))
    alone, ends, at = set(large), [], 0
    for k in range(shards - 1, -1, -1):
        ahead = [i for i in alone if i >= at]
        fair = (sums[-1] - sums[at] - sum(cells[i][2] for i in ahead)) / max(1, k + 1 - len(ahead))
        low, high = max(at, least[k]), bisect_right(sums, sums[at] + capacity) - 1
        near = bisect_left(sums, sums[at] + fair)
        near -= near > at and near < len(sums) and sums[near] - sums[at] - fair > fair - (sums[near - 1] - sums[at])
        if at in alone:
            near = at + 1
        elif any(at < i < near for i in ahead):  # a large cell starts a shard of its own
            near = min(i for i in ahead if i > at)
        at = min(max(low, min(near, last)), high)
        ends.append(at)
    return ends


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Binary search for the smallest capacity that greedy filling needs at most ``shards`` shards for."""
    sums = [0, *accumulate(sizes)]
    low, high = max([-(-sums[-1] // shards), *sizes]), max(1, sums[-1])
    low = min(low, high)
    while low < high:
        mid = (low + high) // 2
        if greedy(sums, shards, mid) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _doubtful(cells: list[Cell], shards: int, capacity: int) -> list[int]:
    """Divisible cells at which greedy filling below ``capacity`` stops, and those its cuts may yet reach."""
    sums = [0, *accumulate(c[2] for c in cells)]
    stops, at = [], 0
    for _ in range(shards):
        at = bisect_right(sums, sums[at] + capacity - 1) - 1
        if at < len(cells):
            stops.append(at)
    must = [i for i in dict.fromkeys(stops) if cells[i][3] > 1 and cells[i][1] < 64]
    if not must:
        return []
    # The k-th cut lies between k times the lower bound and k times the capacity: splitting there saves rounds.
    least = max([-(-sums[-1] // shards), *(c[2] for c in cells if c[3] == 1 or c[1] == 64)])
    also = []
    for k in range(1, shards + 1):
        lo, hi = bisect_right(sums, k * min(least, capacity)) - 1, bisect_right(sums, k * capacity) - 1
        also += [i for i in range(max(0, lo), min(hi, len(cells) - 1) + 1) if cells[i][3] > 1 and cells[i][1] < 64]
    also.sort(key=lambda i: -cells[i][2])
    return sorted(dict.fromkeys(must + also[: max(0, MAX_CELLS - len(must))]))


def _top(hashed, bits: int):
    """The leading bits of the signed hash, ordered as the signed values are."""
    return F.shiftright(hashed, 64 - bits)


def _cells(groups: DataFrame, cells: list[Cell] | None) -> list[Cell]:
    """The first cells, or what the given ones split into."""
    if cells is None:
        bits, rows = TOP_BITS, groups
    else:
        bits = cells[0][1]
        rows = groups.where(_top(F.col("h"), bits).isin([c[0] >> (64 - bits) for c in cells]))  # at most MAX_CELLS values
        bits = min(64, bits + SPLIT_BITS)
    found = rows.groupBy(_top(F.col("h"), bits).alias("top")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # bounded, see above
    return sorted((r.top << (64 - bits), bits, r.size, r.n) for r in found)


def bounds(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """``groups(h, size)`` to the smallest capacity and the first hash of each shard after the first."""
    cells = _cells(groups, None)
    while cells:
        capacity = smallest_capacity([c[2] for c in cells], shards)
        doubtful = _doubtful(cells, shards, capacity)
        if not doubtful:
            break
        split = [cells[i] for i in doubtful]
        finer = [x for bits in sorted({c[1] for c in split}) for x in _cells(groups, [c for c in split if c[1] == bits])]
        gone = set(doubtful)
        cells = sorted([c for i, c in enumerate(cells) if i not in gone] + finer)
    if not cells:
        return 0, []
    ends = level(cells, shards, capacity)
    return capacity, [cells[e][0] for e in ends[:-1] if e < len(cells)]


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` per row; shard bytes are near equal."""
    text = F.col("text")
    rows = id_and_text(df, id_col, text_col).select(
        "doc_id", F.xxhash64(text).alias("h"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = staged(rows.withColumn("dealt", F.monotonically_increasing_id()), "sizes")
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"))
    _, starts = bounds(staged(groups, "groups"), shards)
    place = F.lit(0)
    for first in starts:  # at most shards - 1 terms
        place = place + (F.col("h") >= F.lit(first)).cast("int")
    salts = max(64, -(-rows.count() // (GROUP_ROWS * shards)))
    # A salt from the row's number, so that repeats spread; the number is stored, so a repeated task deals alike.
    dealt = rows.withColumn("shard", place).withColumn("salt", F.pmod(F.xxhash64("dealt"), F.lit(salts)).cast("int"))
    sizes = dealt.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("shard", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "h", "dealt"))
    return (
        dealt.withColumn("rank", rank)
        .join(offsets, ["shard", "salt"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
