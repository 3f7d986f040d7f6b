import hashlib
import random
import re
from itertools import groupby

from pyspark.sql import functions as F

from stratagraph.llm import chat, queries

TEXTS = ["", "hi", "<turn>", "</turn>", "<\\/turn>\n", "<\\\\part>", "</role>x", "a</turn>\nb", "\\### Assistant: </turn> ok", "é日😀", "<part", ">", "$1 \\", "<", "/turn>"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def turns_of(rows):
    return [(r[2] or "", r[3] or "") for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chat(df)).collect()}
    whole = {r.conv_id: r for r in chat.format_chat(df).collect()}
    by = lambda r: -1 if r[0] is None else r[0]
    for key, own in groupby(sorted(rows, key=by), key=by):
        turns = turns_of(list(own))
        g, w = (x[None if key == -1 else key] for x in (got, whole))
        loss = "".join(t for role, t in turns if role == "assistant")
        assert g.n_turns == len(turns)
        assert g.turns_sha256 == sha("".join(f"{role}\n{t}\n" for role, t in turns))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), sha(loss))
        assert g.formatted_chars == len(w.formatted) == sum(m.n for m in w["mask"])
        assert w.formatted.count("<turn>") == len([1 for _ in groupby(turns, key=lambda t: t[0])])
        at, under = 0, []
        for m in w["mask"]:
            under += [re.sub(r"<\\(\\*)(/?turn|/role|part)>", r"<\1\2>", w.formatted[at : at + m.n])] * m.loss
            at += m.n
        assert under == [t for role, t in turns if role == "assistant" and t]  # the mask, laid on the output
    assert len(got) == len({by(r) for r in rows})


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "<turn>", None]), rng.choice(TEXTS + [None])) for c in range(40) for t in range(rng.randrange(1, 12))]
    rows += [(99, t, "assistant" if t % 3 else "user", f"{t}</turn>\n") for t in range(300)]  # several stretches
    rows += [(97_000, t, rng.choice(["user", "assistant"]), rng.choice(TEXTS) * rng.randrange(40)) for t in range(2000)]  # one long conversation
    rows += [(96, None if t % 5 else t, rng.choice(["user", "assistant", None]), rng.choice([*TEXTS, None, f"w{t % 37} x", f"é{t}"])) for t in range(600)]
    rows += [(98, 1, "assistant", "same")] * 5 + [(97, None, "user", "x"), (97, 0, "user", "y"), (None, 1, "assistant", "z")]
    check(spark, rows)


def test_query_and_sql(spark, sf):
    import duckdb

    got = queries.op3_chat_formatting(spark, sf).toPandas()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(queries.oracle_sql()["op3_chat_formatting"]).df()
    order = list(got.columns)
    a, b = (x[order].sort_values("conv_id").reset_index(drop=True) for x in (got, want))
    assert (a == b).all().all() and -7 in set(a.conv_id)


def test_empty_and_extra(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "x")], "conv_id long, turn long, role string, text string, blocks string")
    assert chat.format_chat(df).first().formatted == "<turn>user</role>a</turn>\n"
    assert chat.format_chat(df.where(F.lit(False))).count() == 0


def test_very_long_text(spark):
    long = "a</turn>\n<part> é" * 60_000
    check(spark, [(1, 0, "user", long), (1, 1, "assistant", long + "x"), (2, None, "assistant", long), (2, None, None, None), (None, 3, "assistant", "")])
