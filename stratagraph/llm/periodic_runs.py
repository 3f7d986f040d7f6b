"""Periodic runs of words: every maximal repetition of a text, in time linear in its words.

The words of a text are numbered, and any order of the numbers will do. For that order and its reverse the next
smaller suffix of every position is found (the Lyndon array: the longest Lyndon word at i ends before ``nss[i]``),
with the length of what both suffixes share. A run's Lyndon root is such a word in one of the two orders (Bannai
et al.), so the run is the word extended to both sides.

* ``right_extensions``: positions from left to right with a stack of candidates. No symbol is compared twice: what
  lies inside the match that reaches farthest is read off the same match one period earlier, and after a pop the
  match of the popped position with the one below bounds the next.
* ``left_extensions``: from right to left, by the same mirroring.

So there are no suffix arrays or trees and no hashes. Before that, text is cut at words that stand only once
between two cuts: such a word lies in no run, nor does a run reach across it.

Defined results: a null text has no words and no runs; a null id keeps its row; repeated rows each get a row; an
empty table gives no rows; further columns are ignored. One text is one row, and is worked on in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import id_and_text

#: Words that a run has at least.
LEAST = 12
SCHEMA = "doc_id long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

Run = tuple[int, int, int]


def right_extensions(s: list[int]) -> tuple[list[int], list[int]]:
    """The next smaller suffix of each position (``len(s)`` for none), and how far both agree."""
    n = len(s)
    smaller_at, shared = [n] * n, [0] * n
    before, shared_before = [-1] * n, [0] * n  # the previous smaller suffix, and how far both agree
    stack = [0] if n else []
    far_i = far_j = reach = 0  # the match s[far_i:] = s[far_j:reach] that reaches farthest
    for j in range(1, n):
        popped, same = -1, 0
        while stack:
            p = stack[-1]
            known = shared_before[popped] if popped >= 0 else same
            if known != same:  # p and the popped position part before, or after, the popped one and j do
                falls, same = known > same, min(known, same)
            else:
                if j < reach:
                    if far_j == j:
                        same = reach - j
                    else:
                        d = far_j - far_i
                        q, k = p - d, j - d
                        seen = shared[q] if q >= 0 and smaller_at[q] == k else shared_before[k] if q >= 0 and before[k] == q else n
                        same = min(seen, reach - j)
                e, f = j + same, p + same
                if e >= reach or same == 0:
                    while e < n and s[e] == s[f]:
                        e += 1
                        f += 1
                same = e - j
                falls = e == n or s[e] < s[f]
                if e >= reach:
                    far_i, far_j, reach = p, j, e
            if not falls:
                before[j], shared_before[j] = p, same
                break
            smaller_at[p], shared[p] = j, same
            popped = stack.pop()
        stack.append(j)
    return smaller_at, shared


def left_extensions(s: list[int], smaller_at: list[int]) -> list[int]:
    """How far the texts before each position and before its next smaller suffix agree, backwards."""
    n = len(s)
    shared = [0] * n
    ends = np.array(smaller_at, np.int64)
    words = np.array(s, np.int64)
    at = np.flatnonzero(ends < n)
    at = at[at > 0]
    at = at[words[at - 1] == words[ends[at] - 1]]
    far_i = far_j = reach = n  # the match s[reach:far_i] = s[...:far_j] that reaches farthest
    for i in at[::-1].tolist():
        j, known = smaller_at[i], 0
        if reach < i < far_i:
            seen, most = shared[i + far_j - far_i], i - reach
            if seen != most:
                shared[i] = min(seen, most)
                continue
            known = seen
        a, b = i - known - 1, j - known - 1
        while a >= 0 and s[a] == s[b]:
            a -= 1
            b -= 1
        shared[i] = i - 1 - a
        if a + 1 < reach:
            far_i, far_j, reach = i, j, a + 1
    return shared


def pieces(s: np.ndarray, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """The stretches of at least ``least`` symbols in which each symbol stands twice; no run lies elsewhere."""
    left = [(0, len(s))]
    while left:
        lo, hi = left.pop()
        if hi - lo < least:
            continue
        _, which, times = np.unique(s[lo:hi], return_inverse=True, return_counts=True)
        alone = np.flatnonzero(times[which] == 1)
        if not len(alone):
            yield lo, hi
            continue
        cuts = np.concatenate([[lo - 1], alone + lo, [hi]])
        wide = np.flatnonzero(np.diff(cuts) > least)
        left += [(int(cuts[k]) + 1, int(cuts[k + 1])) for k in wide]


def find(symbols: np.ndarray, least: int = LEAST) -> list[Run]:
    """``(start, length, period)`` of every run of at least ``least`` symbols and two periods, by start, then period."""
    found: set[Run] = set()
    for lo, hi in pieces(symbols, least):
        own = symbols[lo:hi]
        for order in (own, own.max() - own):
            s = order.tolist()
            smaller_at, right = right_extensions(s)
            left = left_extensions(s, smaller_at)
            i, j, r, b = np.arange(hi - lo), np.array(smaller_at), np.array(right), np.array(left)
            period, length = j - i, j - i + r + b
            good = (j < hi - lo) & (length >= np.maximum(2 * period, least))
            found.update(zip((lo + i - b)[good].tolist(), length[good].tolist(), period[good].tolist(), strict=True))
    return sorted(found, key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, in order of first appearance."""
    ids: dict[bytes, int] = {}
    return np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that stay when each run keeps its first period only."""
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()] if runs else words


def find_runs(df: DataFrame, least: int = LEAST, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``(doc_id, runs, collapsed)`` per row: all runs by start and period, and the text with each run cut to one period.

    Words are split at the six ASCII spaces and joined by one space. ``prepare(id, words)`` may change the words first.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_py() or "").encode().split()
                words = prepare(i, words) if prepare else words
                own = find(numbered(words), least)
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in own])
                texts.append(b" ".join(collapsed(words, own)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    return id_and_text(df).mapInArrow(work, SCHEMA)


def made_periodic(i: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the query's contract sets: every tenth document repeats a part of itself to its end."""
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def digests(runs: DataFrame) -> DataFrame:
    """The contract's columns of ``find_runs``: the longest run (then the first, then the shortest period), and digests."""
    key = F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")))
    best = runs.withColumn("best", F.array_max(key))
    line = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
