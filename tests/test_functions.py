import random
import re

import pytest
from pyspark.sql import functions as F

from stratagraph.functions import text as X
from stratagraph.operators import search as S


def test_code_spans():
    good = ["plain", "`a`", "``a ` b``", "```\n`open\n```", "    `indented", "`a\nb`", r"\`", "~~~\n`\n~~~\n`x`"]
    bad = ["`a", "a ``b` c", "`a`\n\n`b", "x\n\n`y\n\nz`"]
    assert [X.has_open_code_span(t) for t in good] == [False] * len(good)
    assert [X.has_open_code_span(t) for t in bad] == [True] * len(bad)


@pytest.mark.parametrize("size", [1, 3, 7, 50])
def test_pages_join_to_the_text(size):
    rng = random.Random(size)
    for _ in range(100):
        text = "".join(rng.choice("ab\né日😀") for _ in range(rng.randrange(60)))
        pages = X.page_text(text, size)
        assert "".join(pages) == text
        assert all(len(p.encode()) <= max(size, 4) for p in pages)
    assert X.page_text("", 5) == [""]


def test_cursor():
    cursor = X.encode_cursor(1, "f", "x\n" * 50)
    assert X.decode_cursor(cursor, "f", "x\n" * 50, 20) == 1
    for bad in ("1", "x:y", cursor.replace("1:", "9:"), X.encode_cursor(99, "f", "x\n" * 50)):
        with pytest.raises(ValueError):
            X.decode_cursor(bad, "f", "x\n" * 50, 20)
    with pytest.raises(ValueError):
        X.decode_cursor(cursor, "f", "other", 20)


def test_byte_cap(spark):
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab é日😀") for _ in range(rng.randrange(30))) for _ in range(60)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for most in (1, 2, 5, 16):
        for r in df.select("t", X.cap_bytes(F.col("t"), most).alias("c")).collect():
            want = r.t.encode()[:most].decode(errors="ignore")
            assert (r.c.text, r.c.truncated) == (want if len(r.t.encode()) > most else r.t, len(r.t.encode()) > most)


def test_lines_and_whole_words(spark):
    texts = ["", "\n", "a", "a\n", "a\r\nb\n\n", "x $the the_ the", "the$"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(X.lines(F.col("t")).alias("x")).collect()] == [t.splitlines() for t in texts]
    word = re.compile(r"(?<![A-Za-z0-9_$])the(?![A-Za-z0-9_$])")
    got = df.select("t", X.whole_word(F.col("t"), F.lit("the")).alias("w"), F.array_contains(X.words(F.col("t")), "the").alias("v")).collect()
    assert all(r.w == r.v == bool(word.search(r.t)) for r in got)


def test_helpers():
    assert X.strip_initialiser("a: Map<x, (y) => z> = f(1)") == "a: Map<x, (y) => z>"
    assert X.strip_initialiser("f(a = 1)") == "f(a = 1)"
    assert X.strip_angles("A<B<C>>x > y<") == "Ax > y"


def test_search_caps(spark):
    files = spark.createDataFrame([(f"lib/f{i:03}", "\n".join(["hit " + "x" * 600] * 3)) for i in range(90)] + [("library/z", "hit")], "file string, text string")
    rows = S.search(files, "hit", scope="lib", context=9).collect()
    assert len(rows) == 200 and all(r.truncated and len(r.line.encode()) == 500 for r in rows)
    assert [r.file for r in rows] == sorted(r.file for r in rows) and not any(r.file.startswith("library") for r in rows)
    assert [len(rows[1].before), len(rows[1].after)] == [1, 1]
    wide = spark.createDataFrame([("a", "\n".join(["hit" + "y" * 490] * 300))], "file string, text string")
    got = S.search(wide, "hit").collect()
    assert len(got) == 200 and sum(len(r.line) for r in got[:-1]) < 100_000


def test_spans_against_a_plain_merge(spark):
    rng = random.Random(2)
    spans = [(k, a, a + rng.randrange(6)) for k in range(20) for a in [rng.randrange(60) for _ in range(9)]]
    want = []
    for k in range(20):
        own = sorted({(a, b) for key, a, b in spans if key == k})
        merged = [list(own[0])]
        for a, b in own[1:]:
            if a <= merged[-1][1] + 2:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(k, a, b) for a, b in merged]
    df = spark.createDataFrame(spans, "k int, start int, end int").distinct()
    assert sorted((r.k, r.start, r.end) for r in S.merge_spans(df, "k").collect()) == want


def test_results_do_not_depend_on_partitions(spark, sf):
    from stratagraph.plans import registry

    for name in ("a20_lineage_vote", "a26_percentiles", "a15_merkle", "j14_route_pattern", "w04_merge_spans"):
        one = sorted(map(tuple, registry.queries()[name](spark, sf).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        two = sorted(map(tuple, registry.queries()[name](spark, sf).collect()), key=repr)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert one == two
