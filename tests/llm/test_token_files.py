import zlib

import numpy as np

from stratagraph.llm import token_files as T
from stratagraph.llm.tokenise import load


def expected(rows):
    start, out = 0, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*load(T.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_round_trip(spark, sf, monkeypatch):
    monkeypatch.setattr(T, "FILE_BYTES", 50_000)  # many files
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.round_trip(docs).collect()}
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_files(spark, tmp_path):
    rows = [(3, "b " * 3000), (1, "A cat"), (2, None), (5, ""), (4, "x" * 10_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = T.write(df, f"file://{tmp_path}/f", length=16)
    want = [i for d, t in sorted(rows, key=lambda r: r[0]) for i in [*load(T.default_tokenizer()).encode(t or "", add_special_tokens=False).ids, 1]]
    got = []
    for r in manifest.orderBy("base").collect():
        batches = T.open_ids(f"file://{tmp_path}/f", r.file)
        n = sum(len(b) for b in batches)
        for k in range(n):
            ids, mask = T.sequence(batches, k)
            assert len(ids) == 16 and not ids.flags.owndata
            got += ids[mask.to_numpy(zero_copy_only=False)].tolist()
        assert sum(len(b) for b in batches) == -(-r.n_ids // 16)
    assert got == want
    back = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.read(manifest, f"file://{tmp_path}/f").collect()}
    assert back == expected(rows)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (1, None, 7)], "doc_id long, text string, start int")
    got = T.round_trip(df).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 1), (1, 1)]
    assert sorted(r.start for r in got) == [0, 3, 4]
    assert T.round_trip(df.limit(0)).count() == 0


def test_one_id_fills_many_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "FILE_BYTES", 20_000)
    df = spark.range(4000).selectExpr("if(id < 3000, 5, id) AS doc_id", "concat('some text ', id % 7) AS text")
    manifest = T.write(df, f"file://{tmp_path}/f").collect()
    sizes = [r.n_ids for r in manifest]
    assert len(sizes) >= 2 and max(sizes) < 0.8 * sum(sizes)  # 3,000 rows of one id are not one file
    got = T.round_trip(df).collect()
    assert len(got) == 4000 and sorted(r.start for r in got)[-1] == sum(r.n_tokens for r in got) - max(got, key=lambda r: r.start).n_tokens
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(r.doc_id for r in got)
