"""Quality rules under weak supervision.

Each rule reads a document's counts and votes good (1) or bad (-1) or abstains (0). How the
votes relate to the unseen quality is estimated from the whole corpus by expectation
maximisation over a two-class model in which rules vote independently within a class; a
document is kept when the posterior probability of the good class is at least one half.

Only the count of each vote pattern leaves the executors: at most 3 ** len(RULES) rows
however large the corpus. Counting is one pass without a shuffle of any text.

Defined results: a null text counts as empty; a text with under 50 words fails the base
rule; repeated rows each get a row; a null doc_id keeps its row; an empty table gives no
rows; extra columns are ignored by ``judge`` and kept as they are by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.llm.common import carried, id_and_text, staged

#: Least words, and the largest share (percent) of words inside repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACES, SYMBOLS, ENDS = " \t\n\x0b\x0c\r", "#*$%&|<>", ".!?…。"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_letters", "n_upper", "n_lower", "n_runs", "n_letter_words", "n_ends",
)

# A character's classes, as bits.
_SPACE, _SYMBOL, _LETTER, _UPPER, _LOWER, _END, _MARK = (1 << k for k in range(7))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        table[code] = (
            _LETTER * c.isalpha() | _UPPER * c.isupper() | _LOWER * c.islower() | _MARK * (not c.isalnum() and not c.isspace())
        )
    for chars, bit in ((SPACES, _SPACE), (SYMBOLS, _SYMBOL), (ENDS, _END)):
        for c in chars:
            table[ord(c)] |= bit
    return table


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, range(n)), np.int64, n)
    pairs = ids[:-2] * n + ids[1:-1]
    if n >= 1 << 21:  # else three ids fit one 64-bit key as they are
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * n + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def counts(text: str) -> tuple[int, ...]:
    """The counts named in ``COUNTS`` of one text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = _classes()[codes]
    of_kind = np.bincount(kinds, minlength=256)
    total = lambda bit: int(of_kind[np.arange(256) & bit > 0].sum())
    spaces = np.concatenate([[True], kinds & _SPACE > 0, [True]])
    starts = np.flatnonzero(spaces[:-1] & ~spaces[1:])
    ends = np.flatnonzero(~spaces[:-1] & spaces[1:])
    letters = np.concatenate([[0], np.cumsum(kinds & _LETTER > 0)])
    closing = (kinds[ends - 1] & _END > 0) & (ends - starts > 1) if len(ends) else np.zeros(0, bool)
    runs = int(((codes[1:] == codes[:-1]) & (kinds[1:] & _MARK > 0)).sum())
    lines, seen, again = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            again += line in seen
            seen.add(line)
    return (
        len(starts), len(codes) - total(_SPACE), total(_SYMBOL), again, repeated_words(text.encode("utf-8", "surrogatepass").split()),
        lines, total(_LETTER), total(_UPPER), total(_LOWER), runs, int((letters[ends] > letters[starts]).sum()), int(closing.sum()),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text column becomes the columns of ``COUNTS``; the other column passes unchanged."""
    for batch in batches:
        found = np.array([counts(t.as_py() or "") for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(COUNTS)))], names=[batch.schema.names[0], *COUNTS])


def with_counts(df: DataFrame) -> DataFrame:
    """A frame of (one column, text) to (that column, the counts)."""
    name, kind = df.columns[0], df.schema[0].dataType.simpleString()
    return df.mapInArrow(_count, f"`{name}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Rule name to its vote."""
    symbols, letters = _share("n_symbols", "n_words"), _share("n_letters", "word_chars")
    worded, upper = _share("n_letter_words", "n_words"), F.col("n_upper") / F.nullif(F.col("n_upper") + F.col("n_lower"), F.lit(0))
    runs, copies = _share("n_runs", "n_words"), _share("n_dup_lines", "n_lines")
    again, ends, length = _share("n_repeat_words", "n_words"), _share("n_ends", "n_words"), _share("word_chars", "n_words")
    return {
        "symbols": _vote(symbols, symbols > 0.1, symbols <= 0.02),
        "letters": _vote(letters, letters < 0.8, letters > 0.9),
        "worded": _vote(worded, worded < 0.8, worded > 0.95),
        "upper": _vote(upper, upper > 0.3, upper < 0.15),
        "runs": _vote(runs, runs > 0.1, runs < 0.02),
        "copied_lines": _vote(copies, copies > 0.2, copies == 0),
        "repeats": _vote(again, again > 0.3, again < 0.1),
        "sentences": _vote(ends, (ends > 0.6) | (ends == 0), (ends > 0.01) & (ends < 0.35)),
        "word_length": _vote(length, (length < 2.5) | (length > 14), (length >= 3) & (length <= 10)),
    }


def estimate(patterns: np.ndarray, times: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """EM on ``patterns`` (votes -1, 0, 1; a row per pattern) and how often each occurs.

    Returns the posterior of the good class per pattern, P(vote | class) as
    [class, rule, vote + 1] with class 1 good, and the share of the good class. The start is
    the balance of votes; a Dirichlet prior worth a hundredth of the rows holds rules to be
    better than chance, which keeps the classes from changing places.
    """
    one_hot = (patterns[:, :, None] == np.array([-1, 0, 1])).astype(float)
    total = max(1.0, float(times.sum()))
    prior = np.array([[2.0, 1.0, 0.5], [0.02, 1.0, 2.0]])[:, None, :] * total / 400 + 1e-9
    good = 1 / (1 + np.exp(3.0 * (patterns == -1).sum(axis=1) - 0.5 * (patterns == 1).sum(axis=1) - 0.5))
    share, table = 0.5, prior / prior.sum(axis=2, keepdims=True)
    for _ in range(rounds):
        weight = np.stack([1 - good, good]) * times
        table = np.einsum("cp,prv->crv", weight, one_hot) + prior
        table /= table.sum(axis=2, keepdims=True)
        share = float((weight[1].sum() + 1) / (total + 2))
        score = np.einsum("prv,crv->cp", one_hot, np.log(table)) + np.log([[1 - share], [share]])
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
        moved, good = float(np.abs(new - good).max(initial=0)), new
        if moved < tolerance:
            break
    return good, table, share


def _pattern() -> Column:
    code = F.lit(0)
    for vote in rules().values():
        code = code * 3 + vote + 1
    return code.cast("int")


def posteriors(counted: DataFrame) -> DataFrame:
    """``(pattern, posterior)`` for every vote pattern that occurs: at most 3 ** len(rules) rows."""
    spark, width = counted.sparkSession, len(rules())
    found = counted.groupBy(_pattern().alias("pattern")).agg(F.count("*").alias("n")).collect()  # bounded: 3 ** width rows
    codes = np.array([r.pattern for r in found], np.int64)
    votes = codes[:, None] // 3 ** np.arange(width - 1, -1, -1) % 3 - 1 if len(codes) else np.zeros((0, width), np.int64)
    good, _, _ = estimate(votes, np.array([r.n for r in found], float))
    return spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, good, strict=True)], "pattern int, posterior double")


def _judged(counted: DataFrame, table: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        counted.withColumn("pattern", _pattern())
        .join(F.broadcast(table), "pattern", "left")  # bounded as posteriors() is
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.coalesce("posterior", F.lit(0.0)) >= 0.5))
    )


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept and the posterior of good quality."""
    counted = staged(with_counts(id_and_text(df, id_col, text_col)), "counts")
    return _judged(counted, posteriors(counted)).select("doc_id", *COUNTS[:5], "base_failed", "kept", "posterior")


def keep_good(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, columns unchanged. Counts are made twice rather than texts shuffled."""
    rows = with_counts(carried(df, text_col))
    table = posteriors(with_counts(df.select(F.lit(0).alias("none"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))))
    return _judged(rows, table).where("kept").select("row.*")
