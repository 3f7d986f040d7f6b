import pytest

from stratagraph.engine import Engine
from stratagraph.operators import tasks

SYMBOL = "id string, file string, ord int, kind string, parent string, signature string, docstring string, bytes long, is_top_level boolean"


def shown(spark, text, symbols, summaries=(), page=40, most=2):
    files = spark.createDataFrame([("f", text)], "file string, text string")
    rows = [(i, "f", k, kind, parent, sig, doc, size, top) for k, (i, kind, parent, sig, doc, size, top) in enumerate(symbols)]
    return tasks.file_inputs(files, spark.createDataFrame(rows, SYMBOL), spark.createDataFrame(list(summaries), "id string, summary string"), page, most).first()


def test_rungs(spark):
    text = "# About\n\n" + "x = 1\n" * 50
    parts = [(f"f::p{i}", "callable", None, f"def p{i}()", None, 5, True) for i in range(8)]
    small = shown(spark, "a\n", parts)
    assert (small.input_kind, small.input, list(small.pages)) == ("raw", "a\n", ["a\n"])
    few = shown(spark, text, parts[:7])
    assert few.input_kind == "raw" and "".join(few.pages) == text and len(few.pages) > 2
    unwritten = shown(spark, text, parts, [(f"f::p{i}", f"Does {i}") for i in range(7)])
    assert unwritten.input_kind == "raw" and unwritten.input == text
    told = shown(spark, text, [*parts, ("f::LIMIT", "value", None, "LIMIT = 3", None, 9, True)], [(f"f::p{i}", f"Does {i}") for i in range(8)])
    assert told.input_kind == "summaries" and told.input.startswith("FILE: f\n# About\n\ndef p0()\nDoes 0\n\ndef p1()\nDoes 1") and told.input.endswith("\n\nLIMIT = 3")
    assert "".join(told.pages) == told.input and max(len(p) for p in told.pages) <= 40
    big = [("f::C", "container", None, "class C", "All of it.", 250, True), ("f::C::m", "callable", "f::C", "def m()", "One.", 9, False), ("f::free", "callable", None, "def free()", "Hid.", 9, True)]
    outline = shown(spark, text, big)
    assert (outline.input_kind, outline.input) == ("outline", "FILE: f\n# About\n\nclass C\nAll of it.\n\ndef m()\nOne.\n\ndef free()")


def test_rungs_without_anything(spark):
    for text in (None, "", "y\n" * 100):
        row = shown(spark, text, [])
        assert row.input_kind == "raw" and "".join(row.pages) == (text or "") == row.input
    assert tasks.file_inputs(spark.createDataFrame([], "file string, text string"), spark.createDataFrame([], SYMBOL), spark.createDataFrame([], "id string, summary string")).count() == 0


def test_engine_pages_and_answers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    long = "".join(f"def f{i}():\n    return {i}\n\n" for i in range(40))
    (tmp_path / "a/long.py").write_text("# Many\n" + long)
    (tmp_path / "a/bad.py").write_text("def (:\n")
    (tmp_path / "a/cls.py").write_text('class Box:\n    """A box."""\n' + "".join(f"    def g{i}(self):\n        return {i}\n" for i in range(60)))
    e = Engine.build(spark, str(tmp_path))
    seen, cursor, turns = "", None, 0
    while turns == 0 or cursor:
        page = e.file_task("a/long.py", cursor, page=400, most=1)
        seen, cursor, turns = seen + page["source"], page["next_cursor"], turns + 1
    assert seen == "# Many\n" + long and turns == page["pages"] > 2 and page["input_kind"] == "raw"
    box = e.file_task("a/cls.py", page=400, most=1)
    assert box["input_kind"] == "outline" and "class Box" in box["source"] and "return" not in e.file_inputs("a/cls.py", 400, 1).first().input
    with pytest.raises(ValueError):
        e.file_task("a/long.py", "1:000000000000", page=400, most=1)
    with pytest.raises(ValueError):
        e.file_task("a/none.py")
    got = e.coverage_answer()
    assert got["all"]["missing"] == got["all"]["total"] == sum(r["total"] for r in got["by_kind"]) and got["weighted_freshness"] == 1.0
    assert {r["file"] for r in got["partly_read"]["worst"]} == {"a/bad.py"} and got["generated"] is None and got["next_cursor"] is None
    assert {r["id"] for r in got["pending"]} >= {"a/long.py", "a/cls.py"} and got["orphaned"] == [] and len(got["top_stale"]) == 2
    assert got["generations_remaining"] >= 43
