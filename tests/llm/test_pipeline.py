import corpus_pipeline
from stratagraph.llm import quality_cnn, quality_rules
from stratagraph.llm.common import staged
from test_near_copies import brute_kept
from test_packing import check_pack


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_dedup", "packing"]
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = staged(stage(spark, now, sf), name)
        assert now.columns == docs.columns
        steps[name] = sorted(r.doc_id for r in now.select("doc_id").collect())
    kept = sorted(r.doc_id for r in quality_rules.judge(docs).where("kept").collect())
    assert steps["quality_rules"] == kept and 0 < len(kept) < len(rows)
    net = quality_cnn.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {i: float(net.probability(net.pooled(quality_cnn.cut(rows[i].text)).mean(axis=0, keepdims=True))[0]) for i in kept}
    good = [i for i in kept if scores[i] >= 0.5]
    assert steps["quality_classifier"] == good
    assert steps["near_dedup"] == brute_kept([(i, rows[i].text) for i in good]) != good
    check_pack(corpus_pipeline.run(spark, sf).collect(), [(i, rows[i].text) for i in steps["near_dedup"]])


def test_edge_rows(spark, sf, tmp_path):
    """Nulls, empty and very long texts, repeated rows, columns named like the stages' own, and empty tables."""
    import random

    rng = random.Random(4)
    clean = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en' AND n_chars > 400").limit(3).collect()
    text = clean[0].text
    long = " ".join(w for _ in range(3000) for w in rng.sample(text.split(), 20)) + "."
    rows = [(1, text, "a", 1.0), (1, text, "a", 1.0), (2, None, None, None), (None, clean[1].text, "b", 0.1), (3, "", "b", 0.2), (4, long, "c", 0.3), (None, None, None, None), (5, clean[2].text, "fp", 0.4), (5, clean[2].text, "other", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, score double")
    plain = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = staged(stage(spark, plain, sf), "edge")
        assert plain.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text) for r in plain.collect()))
    assert [i for i, _ in got if i in (1, 5)] == sorted({i for i, _ in got if i in (1, 5)}) and not [t for _, t in got if not t]
    near = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert sorted((r.doc_id or 0) for r in near.collect()) == [0, 1, 2, 4, 5]  # texts without words are copies: 2 stays
    packed = corpus_pipeline.pack(spark, docs, sf).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and sum(r.start == 0 for r in packed) == len(rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {"pipeline"} <= names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
