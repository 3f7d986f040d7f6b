import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from stratagraph.sources import index as I
from stratagraph.sources import repo
from stratagraph.streaming import sessions as S
from stratagraph.streaming import watch


def test_debounce_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    events = [(0, "a"), (100, "b"), (350, "a"), (700, "c"), (3_000, "d"), (60_000, "z")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text("\n".join(json.dumps({"ts": (t0 + dt.timedelta(milliseconds=ms)).isoformat(), "k": 1, "path": p}) for ms, p in events))
    stream = spark.readStream.schema("ts timestamp, k int, path string").json(str(tmp_path / "in"))
    q = S.debounce_stream(stream, "k", "ts", "path").writeStream.outputMode("append").format("memory").queryName("debounced").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r.paths): r.n for r in spark.sql("SELECT * FROM debounced").collect()}
    assert got.items() >= {("a", "b"): 3, ("c",): 1, ("d",): 1}.items()
    batch = S.debounce_batch(spark.read.schema("ts timestamp, k int, path string").json(str(tmp_path / "in")), "k", "ts", 0.3)
    assert sorted(r.n for r in batch.collect()) == [1, 1, 1, 3]


def _until(test, seconds=60):
    end = time.monotonic() + seconds
    while not test():
        assert time.monotonic() < end, "nothing came"
        time.sleep(0.2)


def test_the_last_run_comes_out_by_silence_and_after_a_restart(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    (tmp_path / "in").mkdir()

    def put(name, events):
        (tmp_path / "tmp.json").write_text("\n".join(json.dumps({"ts": None if ms is None else (t0 + dt.timedelta(milliseconds=ms)).isoformat(), "k": k, "path": p}) for ms, k, p in events))
        (tmp_path / "tmp.json").rename(tmp_path / f"in/{name}.json")

    def start(silence):
        stream = spark.readStream.schema("ts timestamp, k string, path string").json(str(tmp_path / "in"))
        runs = S.debounce_silence(stream, "k", "ts", "path", silence)
        return runs.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()

    def seen():
        return sorted((r.k or "", tuple(r.paths), r.n) for r in spark.read.schema("k string, paths array<string>, n long").parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out").exists() else []

    put("1", [(9_000, "a", "late"), (0, "a", "x"), (100, "a", "y"), (350, "a", "x"), (3_000, "a", None), (0, None, "n"), (None, "a", "no time")])
    first = [("", ("n",), 1), ("a", (), 1), ("a", ("late",), 1), ("a", ("x", "y"), 3)]
    q = start(300)
    try:
        _until(lambda: len(seen()) >= 4)  # no event follows
        assert seen() == first
    finally:
        q.stop()
    q = start(15_000)  # the timer is kept in the checkpoint
    try:
        put("2", [(60_000, "b", "z"), (60_200, "b", "w")])
        _until(lambda: any(p.numInputRows >= 2 and p.stateOperators[0].numRowsTotal for p in q.recentProgress))
        assert seen() == first
    finally:
        q.stop()
    q = start(15_000)
    try:
        _until(lambda: len(seen()) > len(first))
        assert seen() == sorted([*first, ("b", ("w", "z"), 2)])
    finally:
        q.stop()


def test_merge_and_snapshots(spark, tmp_path):
    index = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "file string, source_hash string")
    new, moved = S.merge(index, spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None), ("d", "4"), ("e", None)], "file string, source_hash string"))
    assert sorted((r.file, r.source_hash) for r in new.collect()) == [("a", "1"), ("b", "9"), ("d", "4")]
    assert sorted(r.file for r in moved.collect()) == ["b", "c", "d"]
    snap = S.Snapshots(str(tmp_path / "s"))
    assert snap.current() is None
    first = snap.publish({"index": index})
    held = snap.read(spark, "index")
    assert snap.publish({"index": new}) != first
    assert held.count() == 3 and snap.read(spark, "index").count() == 3 and {r.file for r in snap.read(spark, "index").collect()} == {"a", "b", "d"}


def test_an_edit_rewrites_one_bucket(spark, tmp_path):
    snap = S.Snapshots(str(tmp_path / "s"))
    snap.publish({"index": spark.range(200).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("1").alias("source_hash"))}, buckets=8)
    first = snap.current()["tables"]["index"]["folders"]
    held = snap.read(spark, "index")
    edit = spark.createDataFrame([("f7", "2")], "file string, source_hash string")
    snap.update("index", edit, lambda old: S.merge(old, edit)[0])
    second = snap.current()["tables"]["index"]["folders"]
    assert len(first) == 8 and [b for b in first if first[b] != second[b]] == [str(b) for b in snap.touched("index", edit)]
    assert held.where("source_hash = '1'").count() == 200
    assert snap.read(spark, "index").count() == 200 and [r.file for r in snap.read(spark, "index").where("source_hash = '2'").collect()] == ["f7"]
    gone = snap.read(spark, "index", snap.touched("index", edit)).select("file", F.lit(None).cast("string").alias("source_hash"))
    snap.update("index", gone, lambda old: S.merge(old, gone)[0])
    assert len(snap.current()["tables"]["index"]["folders"]) == 7 and snap.read(spark, "index").count() < 200
    assert snap.expire(1) == 2 and snap.read(spark, "index").count() > 0
    with pytest.raises(RuntimeError):
        snap._commit("late", {}, 3)
    with pytest.raises(ValueError):
        snap.update("index", edit, lambda old: spark.range(50).select(F.concat(F.lit("g"), "id").alias("file"), F.lit("1").alias("source_hash")))


def test_watch_keeps_the_index_current(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("def a():\n    return 1\n")
    (root / "_b.py").write_text("x = 1\n")
    watch.register(spark)
    empty = I.extract(repo.routed(spark.createDataFrame([], "file string, text string"), "python"))
    snap = S.Snapshots(str(tmp_path / "s"))
    snap.publish({"index": empty})

    def extract(batch):
        made = I.extract(repo.routed(batch.where("text IS NOT NULL").select("file", "text"), "python"))
        gone = batch.where("text IS NULL").select("file").withColumns({c: F.lit(None).cast(t) for c, t in made.dtypes if c != "file"})
        return made.unionByName(gone.select(*made.columns))

    stream = spark.readStream.format("file_watch").option("root", str(root)).load()
    q = S.maintain(stream, snap, str(tmp_path / "c"), extract)
    try:
        q.processAllAvailable()
        assert {r.file for r in snap.read(spark, "index").collect()} == {"a.py", "_b.py"}
        version = snap.current()["version"]
        (root / "a.py").write_text("def a():\n    return 1\n")  # the same text again moves nothing
        q.processAllAvailable()
        (root / "a.py").write_text("def a():\n    return 22\n")
        (root / "_b.py").unlink()
        (root / "c.py").write_text("y = 2\n")
        q.processAllAvailable()
    finally:
        q.stop()
    rows = {r.file: r.text for r in snap.read(spark, "index").collect()}
    assert set(rows) == {"a.py", "c.py"} and "22" in rows["a.py"] and snap.current()["version"] != version
