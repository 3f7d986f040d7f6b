"""Packing by minimum bin slack.

Every document is tokenised (an end id closes it) and cut at multiples of the window, so each
has some full windows and at most one remainder of 1 to window - 1 ids. Full windows are
sequences as they stand. Remainders are packed by their lengths alone: a histogram of at most
window - 1 counts, whatever the corpus, goes to the driver. There a bitset subset-sum dynamic
program over the lengths still left finds the total closest to the window, backtracking gives
how many of each length reach it, and the found multiset is repeated as often as the counts
allow. Each repetition run uses up a length or leaves fewer copies of one than the multiset
takes, so the plan stays a few thousand rows at any scale.

A window that even the closest multiset leaves short is filled by the head of one more remainder;
what that has left is a remainder of its own and takes part in the next program. So every window is
full but the last.

Remainders are numbered within their length by a two-level rank (salt groups, then offsets), so
no task sees all remainders of a common length; each number's slot follows from the plan.

A sequence is padded to the window unless its length is a power of two.

Defined results: a null text counts as empty (its only id is the end id); repeated rows and
rows with equal or null ids are documents of their own; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.llm.common import id_and_text, staged
from stratagraph.llm.tokenise import ByteEncoder

WINDOW, END_ID = 1024, 0
#: Remainders in a rank group on average.
GROUP_ROWS = 2_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pieces(path: str, window: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder(path)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * window
        for batch in batches:
            at, starts, lengths, sums, totals, salts, ids = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                data = encoder.encode(text.as_py() or "").astype("<u4").tobytes() + end
                salt = zlib.crc32(data)
                for start in range(0, len(data), step):
                    piece = data[start : start + step]
                    at.append(i)
                    starts.append(start // 4)
                    lengths.append(len(piece) // 4)
                    sums.append(zlib.crc32(piece))
                    totals.append(len(data) // 4)
                    salts.append(salt)
                    ids.append(piece if with_ids or len(piece) < step else None)
            out = [batch.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals, salts))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(ids, pa.binary())], names=[*names, "ids"])

    return run


def closest(left: dict[int, int], window: int) -> dict[int, int]:
    """The multiset (length to copies) of the lengths left whose total is closest to the window, long ones first among equals."""
    # Bounded subset sums: each length in chunks of 1, 2, 4, ... copies; bit t of a state: total t can be made.
    items = []
    for n in sorted(left):
        free, size = min(left[n], window // n), 1
        while free > 0:
            take = min(size, free)
            items.append((n, take))
            free -= take
            size *= 2
    mask, states = (1 << (window + 1)) - 1, [1]
    for n, take in items:
        states.append(states[-1] | (states[-1] << (n * take) & mask))
    total = states[-1].bit_length() - 1
    used: dict[int, int] = {}
    for k in range(len(items) - 1, -1, -1):
        n, take = items[k]
        if total >= n * take and states[k] >> (total - n * take) & 1:  # long lengths go in whenever they can
            used[n] = used.get(n, 0) + take
            total -= n * take
    return used


#: Remainders ``low`` to ``high`` of ``length``, of which the first ``skip`` ids are placed already.
Run = tuple[int, int, int, int]


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, list[tuple[int, int]], int, int]]:
    """How remainders (length to how many) fill windows: (first window, windows, [(length, copies in each)], filler, head).

    Each step takes the closest multiset and repeats it while the counts last. Where it leaves a window
    short, ``head`` ids of one more remainder, of length ``filler``, fill it; the rest of that one is a
    remainder of length ``filler - head`` from then on. Filler and head are 0 where the window is full,
    and in the last window.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    out, first = [], 0
    while left:
        used = closest(left, window)
        slack = window - sum(n * k for n, k in used.items())
        after = {n: c - used.get(n, 0) for n, c in left.items() if c > used.get(n, 0)}
        # All that is left over is longer than the slack, or it would be in the multiset; the longest is cut.
        filler = max(after) if slack and after else 0
        head = slack if filler else 0
        taken = dict(used)
        if filler:
            taken[filler] = taken.get(filler, 0) + 1
        times = min(left[n] // k for n, k in taken.items())
        out.append((first, times, sorted(used.items(), reverse=True), filler, head))
        first += times
        for n, k in taken.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        if filler:
            left[filler - head] = left.get(filler - head, 0) + times
    return out


def slots(counts: dict[int, int], window: int) -> list[tuple[int, ...]]:
    """Where the remainders of each length go, by their numbers: rows

    (length, first number, end number, ids skipped, ids placed, what the first number counts as,
    copies in a window, first window, offset there): number n of the length has ``placed`` ids in window
    first + (n - low + base) div copies at offset + (n - low + base) mod copies * placed.
    """
    pool: dict[int, list[Run]] = {n: [(n, 0, 0, c)] for n, c in counts.items() if c > 0}  # by what is left of their lengths
    out = []

    def take(n: int, many: int) -> list[Run]:
        got, need = [], many
        while need:
            length, skip, low, high = pool[n].pop()
            if high - low > need:
                pool[n].append((length, skip, low + need, high))
                high = low + need
            got.append((length, skip, low, high))
            need -= high - low
        return got

    for first, times, used, filler, head in plan(counts, window):
        offset = 0
        cut = take(filler, times) if filler else []
        for n, k, runs in [*((n, k, take(n, k * times)) for n, k in used), *([(head, 1, cut)] if filler else [])]:
            base = 0
            for length, skip, low, high in runs:
                out.append((length, low, high, skip, n, base, k, first, offset))
                base += high - low
            offset += n * k
        for length, skip, low, high in cut:
            pool.setdefault(filler - head, []).append((length, skip + head, low, high))
    return out


def _numbered(df: DataFrame, key: str, groups: int) -> DataFrame:
    """``df`` with ``number``: gapless from 0 within ``key``. Ranks in salt groups plus the groups' offsets."""
    df = df.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "salt", "dealt"), F.lit(groups)))
    sizes = df.groupBy(key, "g").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(key, "g", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(key, "g").orderBy("doc_id", "start", "salt", "dealt"))
    return df.withColumn("rank", rank).join(offsets, [key, "g"]).withColumn("number", F.col("before") + F.col("rank") - 1).drop("g", "rank", "before")


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece: where it comes from, and its sequence and offset there.

    ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` and, if asked for,
    ``ids``: the piece's ids, little-endian unsigned 32-bit.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, salt long, ids binary"
    pieces = id_and_text(df, id_col, text_col).mapInArrow(_pieces(tokenizer or default_tokenizer(), window, end_id, with_ids), fields)
    # dealt: tells repeated rows apart; fixed once written
    pieces = staged(pieces.withColumn("dealt", F.monotonically_increasing_id()), "pieces")
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # bounded: a row per length, at most the window
    counts = {r.length: r.n for r in found}
    full = counts.pop(window, 0)
    table = spark.createDataFrame(slots(counts, window), "of long, low long, high long, skip long, many long, base long, copies long, first long, offset0 long")  # bounded by the plan
    keys = ["doc_id", "start", "salt", "dealt"]
    numbered = _numbered(pieces.where(F.col("length") < window).select(*keys, "length", "ids_crc32", "doc_tokens", "ids"), "length", max(16, -(-sum(counts.values()) // GROUP_ROWS)))
    put = numbered.join(F.broadcast(table), (F.col("length") == F.col("of")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")))
    place = F.col("number") - F.col("low") + F.col("base")
    own = F.expr("substring(ids, cast(4 * skip + 1 as int), cast(4 * many as int))")
    rests = put.select(
        "doc_id",
        (F.col("start") + F.col("skip")).alias("start"),
        F.col("many").alias("length"),
        F.when(F.col("many") == F.col("length"), F.col("ids_crc32")).otherwise(F.crc32(own)).alias("ids_crc32"),
        "doc_tokens",
        (full + F.col("first") + F.floor(place / F.col("copies"))).alias("sequence_id"),
        (F.col("offset0") + F.pmod(place, F.col("copies")) * F.col("many")).cast("long").alias("offset"),
        own.alias("ids"),
    )
    wholes = _numbered(pieces.where(F.col("length") == window), "length", max(16, -(-full // GROUP_ROWS))).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids"
    )
    out = wholes.unionByName(rests)
    return out if with_ids else out.drop("ids")
