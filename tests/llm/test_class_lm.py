import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logloom.llm import class_lm
from logloom.llm.class_lm import exchange_classes, score_corpus

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def brute(rows):
    """The base columns of each row."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = Counter()
    for (_, t), h in zip(rows, held, strict=True):
        if not h:
            counts.update([*words(t), None])
    total, kinds = sum(counts.values()), len(counts)
    for (i, t), h in zip(rows, held, strict=True):
        tokens = [*words(t), None]
        yield i, h, len(tokens), sum(counts[w] > 0 for w in tokens), total, sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens)


def sample(n=120):
    r = random.Random(1)
    return [(i, " ".join(r.choice(["The", "cat", "sat", "on", "mat,", f"w{r.randint(0, 60)}"]) for _ in range(r.randint(0, 30)))) for i in range(n)] + [(1000, None), (1001, ""), (None, "the cat"), (5, "the cat"), (5, "the cat"), (2000, "x " * 100_000)]


@pytest.mark.parametrize("frequent", [1 << 18, 20, 0])
def test_base_columns_equal_brute_force(docs, monkeypatch, frequent):
    monkeypatch.setattr(class_lm, "FREQUENT", frequent)
    rows = sample()
    out = score_corpus(docs(rows).withColumns({c: F.lit("clash") for c in ("word", "n", "row", "rare", "known")})).collect()
    key = lambda x: (str(x[0]), x[2], round(x[5], 4))
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out), key=key)
    for a, b in zip(got, sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_scores_don_t_depend_on_what_is_broadcast(docs, monkeypatch):
    # No sweeps here: they give a word that tasks know a class of its own, and a rarer one stays with its group.
    monkeypatch.setattr(class_lm, "MOVES_LEFT", 2.0)
    rows = sample(60)
    key = lambda r: (str(r[0]), r[1])
    got = []
    for frequent in (1 << 18, 25):
        monkeypatch.setattr(class_lm, "FREQUENT", frequent)
        monkeypatch.setattr(class_lm, "CORE_WORDS", 10)
        got.append(sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in score_corpus(docs(rows)).collect()), key=key))
    for a, b in zip(*got, strict=True):
        assert a[2] == pytest.approx(b[2], rel=1e-9)


def test_probabilities_sum_to_one(docs, monkeypatch):
    rows = [(i, " ".join(random.Random(i).choice("abcdef") for _ in range(5))) for i in range(40)]
    model, counts = class_lm.train(docs(rows))
    assert np.allclose((10.0**model.transition).sum(1), 1)
    # In each class its words, and one place for those never seen.
    assert counts.count() == 0
    of = dict(zip(model.symbols.words.tolist(), model.counts.tolist(), strict=True))
    total = np.zeros(class_lm.CLASSES)
    types = np.zeros(class_lm.CLASSES)
    for k, h in enumerate(model.symbols.words):
        c = model.classes[1 + k]
        total[c] += (of[int(h)] + 1) * 10 ** model.emission[c]
        types[c] += 1
    used = types > 0
    assert np.allclose(total[used] + 10 ** model.emission[used], 1)


def test_exchange_finds_the_classes():
    """Words of two kinds that alternate."""
    bigrams = np.zeros((9, 9))
    rng = np.random.default_rng(0)
    for a in range(1, 5):
        for b in range(5, 9):
            bigrams[a, b], bigrams[b, a] = rng.integers(5, 20, 2)
    bigrams[0, 1:5] = bigrams[5:9, 0] = 3
    cls = exchange_classes(bigrams, 3)
    assert cls[0] == 0 and len(set(cls[1:5])) == 1 and len(set(cls[5:9])) == 1 and cls[1] != cls[5]


def test_class_scores_beat_the_base_where_order_counts(docs):
    r = random.Random(0)
    a, b = [f"a{i}x" for i in range(30)], [f"b{i}y" for i in range(30)]
    rows = [(i, " ".join(w for _ in range(20) for w in (r.choice(a), r.choice(b)))) for i in range(200)]
    out = score_corpus(docs(rows)).where("held_out").collect()
    assert len(out) > 10 and all(x["score"] > x["base_score"] for x in out)


def test_edges(docs):
    assert score_corpus(docs([])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = score_corpus(docs([(only, "a b")])).first()  # nothing to learn from
    assert (row["held_out"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 0, 0, 0.0)


def test_words_beyond_the_core_are_clustered(docs, monkeypatch):
    """Two kinds of words that alternate, spelt alike: only their neighbours tell them apart."""
    monkeypatch.setattr(class_lm, "CORE_WORDS", 8)
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    r = random.Random(4)
    spell = lambda k: "w" + "".join("abcdefghij"[int(d)] for d in f"{k:02d}") + "zz"
    a, b = [spell(k) for k in range(0, 80, 2)], [spell(k) for k in range(1, 80, 2)]
    model, _ = class_lm.train(docs([(i, " ".join(w for _ in range(30) for w in (r.choice(a), r.choice(b)))) for i in range(150)]))
    (found,) = class_lm.word_chunks(pa.array([" ".join(a + b)]))
    classes = model.classes[model.symbols.of(found)]
    assert not set(classes[: len(a)].tolist()) & set(classes[len(a) :].tolist())


def test_score_by_a_plain_loop(docs, monkeypatch):
    """score follows from classes, transitions and emissions token by token."""
    monkeypatch.setattr(class_lm, "CORE_WORDS", 10)
    monkeypatch.setattr(class_lm, "FREQUENT", 40)
    rows = sample(80)[:-1]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    df = docs(rows)
    model, _ = class_lm.train(df.where(~class_lm.held_out()))
    counts = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    assert len(model.symbols.words) <= 40 < len(counts)
    got = {r["doc_id"]: r["score"] for r in score_corpus(df).collect()}
    for i, t in rows:
        if i == 5:  # an id of several rows
            continue
        tokens = words(t)
        (chunk,) = class_lm.word_chunks(pa.array([t or ""]))
        classes = [0, *model.classes[model.symbols.of(chunk)].tolist(), 0]
        want = sum(model.transition[a, b] + model.emission[b] for a, b in zip(classes, classes[1:]))
        want += sum(math.log10(counts[w] + 1) for w in [*tokens, None])
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_an_even_table_is_clustered_too(spark):
    """Where all counts are equal, as many rows are taken as may be."""
    df = spark.range(1000).selectExpr("id word", "1L n")
    assert 500 < df.where(class_lm.among_top(df, "n", 700, "word")).count() <= 700


@pytest.mark.parametrize("seed", range(10))
def test_no_single_move_is_left(seed):
    r = np.random.default_rng(seed)
    bigrams = (r.integers(0, 6, (14, 14)) * (r.random((14, 14)) < 0.5)).astype(float)
    cls = exchange_classes(bigrams, 4)
    known = lambda c: class_lm.information(np.eye(4)[c].T @ bigrams @ np.eye(4)[c])
    for w in range(1, 14):
        for k in range(1, 4):
            assert known(np.where(np.arange(14) == w, k, cls)) <= known(cls) + 1e-6


@pytest.mark.parametrize("seed", range(4))
def test_moves_by_plain_loops(spark, monkeypatch, seed):
    """What a symbol's neighbours add to the entropy of each class's counts, one count at a time."""
    monkeypatch.setattr(class_lm, "BLOCK_ENTRIES", 7)
    monkeypatch.setattr(class_lm, "SMALL", 3)
    r = np.random.default_rng(seed)
    size, kinds = 15, 4
    counts = r.integers(0, 9, (size, size)) * (r.random((size, size)) < 0.5)
    pairs = np.flatnonzero(counts)
    halves = [pa.Table.from_batches(class_lm.dealt(pairs // size, [pairs, n], 3, ["part", "pairs", "counts"])) for n in (counts.ravel()[pairs] - 1, np.ones(len(pairs), np.int64))]
    blocks = class_lm.neighbour_blocks(spark.createDataFrame(pa.concat_tables(halves)), size, 3).cache()
    of = np.concatenate([[0], r.integers(1, kinds, size - 1)])
    table = np.eye(kinds)[of].T @ counts @ np.eye(kinds)[of]
    assert np.array_equal(class_lm.class_table(blocks, of, kinds), table) and blocks.count() > 3
    found = dict(zip(*(x.tolist() for x in class_lm.moves(blocks, of, table)), strict=True))
    f = lambda x: x * math.log(x) if x > 0 else 0.0
    for w in range(1, size):
        gains = {}
        for k in range(1, kinds):
            gains[k] = 0.0
            for beside, t in ((counts[w], table), (counts[:, w], table.T)):
                for d in range(kinds):
                    c = beside[of == d].sum()
                    now = t[k, d] - (c if of[w] == k else 0)
                    gains[k] += f(now + c) - f(now)
                now = t[k].sum() - (beside.sum() if of[w] == k else 0)
                gains[k] -= f(now + beside.sum()) - f(now)
        if counts[w].any() or counts[:, w].any():
            assert gains[found.get(w, of[w])] == pytest.approx(max(gains.values()), abs=1e-6)
    _, after = class_lm.swept_classes(blocks, of, kinds)
    assert class_lm.information(after) >= class_lm.information(table)
