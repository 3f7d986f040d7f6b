import zlib

import numpy as np
import pytest

from stratagraph.llm import quality_cnn as Q


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 448, 449, 5000):
        text = "".join(chr(33 + i % 90) for i in range(n))
        chunks = Q.cut(text)
        got = bytes(chunks[0]) + b"".join(bytes(c[Q.CHUNK - Q.HOP :]) for c in chunks[1:])
        assert got.rstrip(b"\0") == text.encode()


def test_pooled_equals_a_plain_loop():
    net, rng = Q.Network.start(1), np.random.default_rng(0)
    chunks = rng.integers(0, 256, (3, Q.CHUNK)).astype(np.uint8)
    for row, got in zip(chunks, net.pooled(chunks), strict=True):
        best = max((net.embed[row[p : p + Q.WIDTH]].ravel() @ net.filters for p in range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE)), key=lambda v: 0)
        every = np.stack([net.embed[row[p : p + Q.WIDTH]].ravel() @ net.filters for p in range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE)])
        assert best.shape == got.shape
        np.testing.assert_allclose(got, np.maximum(every.max(axis=0) + net.bias, 0), rtol=1e-4, atol=1e-5)


def test_gradients_match_differences(monkeypatch):
    rng = np.random.default_rng(5)
    net = Q.Network(*(p.astype(float) for p in Q.Network.start(3).parts()))
    texts = [rng.integers(0, 256, (n, Q.CHUNK)).astype(np.uint8) for n in (1, 4, 2, 7)]
    labels, weight = np.array([1.0, 0.0, 1.0, 0.0]), np.array([0.7, 1.3, 1.0, 0.4])
    monkeypatch.setattr(Q, "AT_ONCE", 3)
    monkeypatch.setattr(Q.Network, "pooled", None)
    _, found = Q.gradients(net, texts, labels, weight)
    for part, got in zip(net.parts(), found, strict=True):
        for at in rng.choice(part.size, min(part.size, 12), replace=False):
            flat, old, sides = part.reshape(-1), part.reshape(-1)[at], []
            for step in (1e-5, -1e-5):
                flat[at] = old + step
                sides.append(Q.gradients(net, texts, labels, weight)[0])
            flat[at] = old
            assert abs((sides[0] - sides[1]) / 2e-5 - got.reshape(-1)[at]) < 1e-4


def test_fitting_reads_whole_texts(spark):
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1][:40]
    docs = [(i, "plain words here " * 400 + ("#### %%%% " * 60 if k % 2 else "more words ") + "plain words here " * 400) for k, i in enumerate(free)]
    labels = spark.createDataFrame([(i, 1 - k % 2) for k, i in enumerate(free)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    net = Q.train(df, labels)
    got = {r.doc_id: r.predicted for r in Q.score(df, net).collect()}
    assert all(got[i] == 1 - k % 2 for k, i in enumerate(free))  # what tells the classes apart is a twentieth of a text


@pytest.fixture(scope="module")
def fitted(spark):
    p = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{p}/documents.parquet"), spark.read.parquet(f"{p}/labels.parquet")
    return docs, labels, Q.train(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, net = fitted
    rows = Q.score(docs, net).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert len(held) > 80
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.9
    assert np.mean([r.predicted for r in held if r.quality == 1]) >= 0.95


def test_held_out_labels_change_nothing(spark, fitted):
    from pyspark.sql import functions as F

    docs, labels, net = fitted
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.train(docs, flipped)
    assert all((a == b).all() for a, b in zip(net.parts(), again.parts(), strict=True))


def test_edge_rows(spark, fitted):
    docs, labels, net = fitted
    df = spark.createDataFrame([(1, None, 0.1), (None, "", 0.2), (3, "x" * 300_000, 0.3), (3, "x" * 300_000, 0.3)], "doc_id long, text string, score double")
    got = Q.score(df, net).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert got[0].score == got[1].score and got[1].held_out is False
    assert Q.keep_good(df, net).columns == df.columns
    assert Q.score(df.limit(0), net).count() == 0
    assert Q.score(df, Q.train(docs, labels.limit(0))).first().score == 0.5


def test_a_repeated_doc_id_trains_once(spark, monkeypatch):
    from stratagraph.llm import quality_cnn

    seen = []
    monkeypatch.setattr(quality_cnn, "fit", lambda chunks, quality, *_: seen.append((len(chunks), sorted(quality.tolist()), b"".join(c.tobytes() for c in chunks))))
    free = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:6]
    docs = [(i, f"text of {i}") for i in free] + [(free[0], f"other text {k}") for k in range(200)]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(free)], "doc_id long, quality int")
    for rows in (docs, docs[::-1]):
        quality_cnn.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert seen[0][:2] == (6, [0, 0, 0, 1, 1, 1]) and seen[0] == seen[1]
