r"""Chat formatting with DataFrame functions only.

A conversation's turns are sorted, adjacent turns of one role are merged into one block by an
array aggregation, and blocks are concatenated:

    <turn>ROLE</role>TEXT<part>TEXT</turn>

with a newline after ``</turn>``. Where a role or text itself holds one of the four control
strings, with any number of backslashes after its ``<``, one backslash is added there; taking
one away is the exact inverse, and other text stays as it is. The loss mask is a list of runs
(code points, whether they count): the texts of assistant turns count, all markup does not.

Turns are aggregated in stretches of ``STRETCH`` turn numbers first, so a conversation with a
large share of all rows is sorted, escaped and merged by many tasks; what meets per
conversation is one row per stretch. Turns without a number are parted by role and the text's
first characters instead.

Defined results: null texts and roles count as empty; a null conv_id is one conversation;
null turns come first; equal turns are ordered by role, then text; repeated rows are turns of
their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, ROLE_END, PART, CLOSE = "<turn>", "</role>", "<part>", "</turn>\n"
#: Turn numbers that are aggregated together first.
STRETCH = 64
LOSS_ROLE = "assistant"
_CONTROL = r"(/?turn|/role|part)>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)" + _CONTROL, r"<\\$1$2>")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)" + _CONTROL, r"<$1$2>")


def _merge(turns: Column) -> Column:
    """Sorted (role, text) structs to blocks (role, texts): neighbours of one role join."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def step(blocks: Column, turn: Column) -> Column:
        n = F.size(blocks)
        last = F.try_element_at(blocks, F.lit(-1))
        joined = F.struct(last.role.alias("role"), F.concat(last.texts, F.array(turn.text)).alias("texts"))
        fresh = F.struct(turn.role.alias("role"), F.array(turn.text).alias("texts"))
        return F.when((n > 0) & (last.role == turn.role), F.concat(F.slice(blocks, 1, F.greatest(n - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(blocks, F.array(fresh))
        )

    return F.aggregate(turns, none, step)


def _run(length: Column, loss: Column) -> Column:
    return F.struct(length.cast("long").alias("n"), loss.alias("loss"))


def stretches(df: DataFrame) -> DataFrame:
    """``(conv_id, stretch, formatted, mask)``: a conversation is its stretches' strings and masks in a row."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Turns without a number are in order of role and text, so they part by role and the text's first characters.
    first = lambda c: F.when(F.col("turn").isNull(), c)
    unnumbered = [first(F.coalesce("role", F.lit(""))).alias("role"), first(F.substring(F.coalesce("text", F.lit("")), 1, 3)).alias("head")]
    found = (
        df.select("conv_id", "turn", "role", "text")
        .groupBy("conv_id", F.struct(F.floor(F.col("turn") / STRETCH).alias("band"), *unnumbered).alias("stretch"))
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .select("conv_id", "stretch", _merge(F.col("turns")).alias("blocks"))
    )
    # The first block goes on from the stretch before if the role is the same; each stretch closes the block before its own.
    order = Window.partitionBy("conv_id").orderBy(F.col("stretch").asc_nulls_first())
    found = found.withColumn("before", F.lag(F.element_at("blocks", -1).role).over(order)).withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    first = F.element_at("blocks", 1).role
    goes_on = F.col("before").isNotNull() & (F.col("before") == first)

    def lead_in(b: Column, i: Column) -> Column:
        header = F.concat(F.lit(OPEN), escape(b.role), F.lit(ROLE_END))
        close = F.when((i > 0) | F.col("before").isNotNull(), F.lit(CLOSE)).otherwise(F.lit(""))
        return F.when((i == 0) & goes_on, F.lit(PART)).otherwise(F.concat(close, header))

    pieces = F.transform(
        "blocks", lambda b, i: F.struct(lead_in(b, i).alias("lead"), (b.role == LOSS_ROLE).alias("loss"), F.transform(b.texts, escape).alias("texts"))
    )
    end = F.when(F.col("last"), F.lit(CLOSE)).otherwise(F.lit(""))
    found = found.select("conv_id", "stretch", pieces.alias("pieces"), end.alias("end"))
    body = F.array_join(F.transform("pieces", lambda p: F.concat(p.lead, F.array_join(p.texts, PART))), "")

    def runs(p: Column) -> Column:
        parts = F.transform(p.texts, lambda t, i: F.array(_run(F.when(i == 0, F.length(p.lead)).otherwise(F.lit(len(PART))), F.lit(False)), _run(F.length(t), p.loss)))
        return F.flatten(parts)

    mask = F.concat(F.flatten(F.transform("pieces", runs)), F.array(_run(F.length("end"), F.lit(False))))
    return found.select("conv_id", "stretch", F.concat(body, F.col("end")).alias("formatted"), F.filter(mask, lambda r: r.n > 0).alias("mask"))


def masked(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask of a formatted conversation, piece by piece in order.

    A piece by its place costs as much as the string before it is long, so the string is cut at every
    root-of-runs-th run first and pieces are cut from those parts.
    """
    at = lambda runs: F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r.n)
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(mask)))).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(mask) - 1) / size).cast("int")), lambda g: F.slice(mask, g * size + 1, size))
    long_array = F.array().cast("array<bigint>")
    before = lambda lengths: F.aggregate(
        lengths, F.struct(F.lit(0).cast("long").alias("at"), long_array.alias("starts")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc.starts, F.array(acc["at"])).alias("starts"))
    ).starts
    cut = lambda text, start, n: F.substring(text, (start + 1).cast("int"), n.cast("int"))

    def inside(part: Column, runs: Column) -> Column:
        placed = F.arrays_zip(runs.alias("r"), before(F.transform(runs, lambda r: r.n)).alias("at"))
        return F.array_join(F.transform(F.filter(placed, lambda p: p["r"]["loss"]), lambda p: unescape(cut(part, p["at"], p["r"]["n"]))), "")

    parts = F.arrays_zip(groups.alias("g"), before(F.transform(groups, at)).alias("at"))
    return F.when(F.size(mask) == 0, F.lit("")).otherwise(F.array_join(F.transform(parts, lambda p: inside(cut(formatted, p["at"], at(p["g"])), p["g"])), ""))


def conversations(pieces: DataFrame) -> DataFrame:
    """Stretches to ``(conv_id, formatted, mask)``."""
    part = F.struct("stretch", "formatted", "mask")
    return (
        pieces.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(part)).alias("parts"))
        .select("conv_id", F.array_join(F.transform("parts", lambda p: p.formatted), "").alias("formatted"), F.flatten(F.transform("parts", lambda p: p["mask"])).alias("mask"))
    )


def format_chat(df: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` to ``(conv_id, formatted, mask)``."""
    return conversations(stretches(df))


def read_back(formatted: Column) -> Column:
    """A formatted conversation's turns: array of (role, text)."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def turns(b: Column) -> Column:
        cut = F.split(b, ROLE_END, 2)
        role = unescape(F.substring(cut[0], len(OPEN) + 1, 2**31 - 1))
        return F.transform(F.split(cut[1], PART), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """What ``format_chat`` returns, as counts and hashes of what is read back from it."""
    rows = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("mask")).alias("loss_text"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
