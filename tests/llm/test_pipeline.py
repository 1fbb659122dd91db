from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm.toxicity import drop_toxic
from tests.llm.test_ngram_join import brute, near_copies
from tests.llm.test_toxicity import corpus


def test_stages_and_run(spark, docs, tmp_path):
    toxic, labels = corpus(200)
    copies = [(10_000 + i, t or "") for i, t in near_copies(3)]
    rows = toxic + copies + [(20_000, toxic[1][1]), (20_001, toxic[1][1] + "  ")]
    df = docs(rows)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "best-fit packing"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # By brute force, stage by stage, from what the model keeps.
    kept = {r["doc_id"] for r in drop_toxic(df, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    rows = [(i, t) for i, t in rows if i in kept]
    best = {}
    for i, t in rows:
        key = "".join(t.split())
        best[key] = min(best.get(key, (0, i)), (-len(t), i))
    stay = {i for _, i in best.values()}
    rows = [(i, t) for i, t in rows if i in stay]
    stay = {i for i, _, c, _ in brute(rows) if i == c}
    assert {r["doc_id"] for r in out} == stay
    assert len(stay) < len(kept) and 20_000 not in stay
    by_sequence = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in by_sequence.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_columns_stay(spark, docs, tmp_path):
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = docs([(1, "a b c"), (2, None), (2, None), (None, "x"), (3, "a b c ")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r["doc_id"]) for r in df.collect()) == ["2", "3", "None"]
