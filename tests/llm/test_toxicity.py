import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm.toxicity import Model, drop_toxic, fit, hashed_terms, score, toxicity, train
from logloom.llm.words import NOT_ALNUM, word_chunks


def corpus(n=600):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 200))]
        bad = i % 4 == 0
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["Vilework", "vilest,", "grubling", "GRUB!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy(labelled):
    df, labels, truth = labelled
    out = toxicity(df, labels).collect()
    assert len(out) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert len(held) > 80 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_scores_depend_on_the_text_alone(labelled):
    df, labels, _ = labelled
    model = train(df, labels)
    a = df.sparkSession.createDataFrame([(1, "so vilest a thing"), (999, "so vilest a thing"), (None, None), (5, ""), (6, "word " * 200_000)], "doc_id long, text string").withColumns({"score": F.lit("clash"), "terms": F.lit("clash")})
    got = [r["score"] for r in score(a, model).collect()]
    assert got[0] == got[1] > 0.5 > got[4] and got[2] == got[3]
    kept = drop_toxic(df.withColumn("score", F.lit("clash")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and 0.7 * df.count() < kept.count() < 0.8 * df.count()


def test_pairs_count_beyond_their_parts():
    rng = np.random.default_rng(0)
    terms = [np.flatnonzero(rng.random(4) < 0.5) for _ in range(2000)]
    y = np.array([float((0 in t) and (1 in t)) for t in terms])
    m = fit(terms, y, np.arange(4), epochs=40)
    rows, flat = np.repeat(np.arange(3), [1, 1, 2]), np.array([0, 1, 0, 1])
    one, other, both = m.scores(rows, flat, 3)
    assert both > 0.5 > max(one, other)


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    m = Model(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 4)))
    t = [0, 2, 3, 5]
    z = 0.3 + sum(m.weights[i] for i in t) + sum(m.factors[i] @ m.factors[j] for a, i in enumerate(t) for j in t[a + 1 :])
    assert m.scores(np.zeros(4, int), np.array(t), 1)[0] == pytest.approx(1 / (1 + np.exp(-z)))


def test_without_labels_and_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity(docs([(1, "a"), (2, None)]), none).collect()] == [0, 0]
    assert toxicity(docs([]), none).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (3, 1), (3, 1)], "doc_id long, toxic int")
    assert toxicity(docs([(1, "a b"), (2, "a c"), (3, "a d")]), odd).count() == 3


def test_terms_don_t_depend_on_the_chunk():
    texts = ["Hello, hello world", "", "worldwide hello!", "ñandú x"]
    whole = [hashed_terms(w) for w in word_chunks(pa.array(texts), blank=NOT_ALNUM)][0]
    for k, t in enumerate(texts):
        alone = [hashed_terms(w) for w in word_chunks(pa.array([t]), blank=NOT_ALNUM)][0]
        assert whole[1][whole[0] == k].tolist() == alone[1].tolist()


def test_terms_that_tell_only_in_pairs(spark):
    """Toxic is exactly one of two terms, which alone tell nothing."""
    r = random.Random(1)
    rows, labels = [], []
    for i in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = ["".join(r.choice("abcd") for _ in range(3)) for _ in range(4)] + ["qqx"] * a + ["zzy"] * b
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(a != b)))
    out = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    truth = dict(labels)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.95


def test_shards_learn_together(spark, labelled, monkeypatch):
    df, labels, truth = labelled
    monkeypatch.setattr("logloom.llm.toxicity.SHARD_ROWS", 120)
    out = toxicity(df, labels).where("held_out").collect()
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.95


def test_scores_by_brute_force(labelled):
    """Every score follows from the terms of the text one by one and pair by pair."""
    df, labels, _ = labelled
    model = train(df, labels)
    number = {int(b): k for k, b in enumerate(model.buckets)}
    rows = df.limit(40).collect()
    want = {}
    for r in rows:
        (words,) = word_chunks(pa.array([r["text"]]), blank=NOT_ALNUM)
        terms = sorted({number[int(b)] for b in hashed_terms(words)[1] if int(b) in number})
        value = model.bias + sum(model.weights[t] for t in terms) + sum(model.factors[a] @ model.factors[b] for a in terms for b in terms if a < b)
        want[r["doc_id"]] = 1 / (1 + np.exp(-value))
    got = {r["doc_id"]: r["score"] for r in score(df.limit(40), model).collect()}
    assert got == pytest.approx(want)
