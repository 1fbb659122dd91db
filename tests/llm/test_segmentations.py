import math
from collections import Counter

import numpy as np
import pytest

from logloom.llm.common import tokenizer
from logloom.llm.segmentations import decode_segmentations, load_pieces, sample_segmentations, sample_texts

PATH = tokenizer("piece_bpe_32k.model")
TEXTS = ["", "hello world", "  two  spaces ", "ñandú 日本語 😀 x\ny\tz ▁lit ￾", "a", "a" * 300, " ", "\n"]


def everything(word, pieces):
    """All segmentations of one word, with log probabilities."""
    text, ids = "▁" + word, {p: i for i, p in enumerate(pieces.texts) if pieces.weights[i] < 0}
    out = {}

    def grow(at, path, weight):
        if at == len(text):
            out[tuple(path)] = weight
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in ids:
                i = ids[text[at:end]]
                grow(end, [*path, i], weight + pieces.weights[i])

    grow(0, [], 0.0)
    total = math.log(sum(map(math.exp, out.values())))
    return {k: v - total for k, v in out.items()}


def test_round_trip_and_distinct():
    pieces, seen = load_pieces(PATH, 3.0), {}
    for t, number, ids, log_prob, value, inclusion in sample_texts(TEXTS, np.arange(len(TEXTS)).astype(np.uint64), pieces, 6):
        assert (pieces.decode(ids.tolist()) if TEXTS[t] else "") == TEXTS[t]
        assert tuple(ids) not in [s[0] for s in seen.setdefault(t, [])]
        assert log_prob <= 1e-9 and 0 < inclusion <= 1 and (not seen[t] or seen[t][-1][1] >= value)
        assert number == len(seen[t]) + 1
        seen[t].append((tuple(ids), value))
    assert len(seen[0]) == 1 and len(seen[1]) == 6


def test_few_segmentations_are_all_found():
    pieces = load_pieces(PATH, 3.0)
    want = everything("wor", pieces)
    got = {tuple(ids.tolist()): (lp, inc) for _, _, ids, lp, _, inc in sample_texts(["wor"], np.array([7], np.uint64), pieces, 50)}
    assert set(got) == set(want) and all(got[k] == (pytest.approx(want[k]), 1.0) for k in want)


def test_pieces_of_several_blanks_are_edges():
    pieces = load_pieces(PATH, 3.0)
    for text in ("a  b", "   a", "a    "):
        want = everything(text.replace(" ", "▁"), pieces)
        got = {tuple(ids.tolist()): lp for _, _, ids, lp, _, _ in sample_texts([text], np.array([7], np.uint64), pieces, len(want) + 5)}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_long_runs_are_not_cut():
    pieces = load_pieces(PATH, 3.0)
    for text in ("internationalization" * 5, "a" * 130, "=" * 70, "https://example.com/some/long/path?with=parameters&and=more"):
        ids, mass = {p: i for i, p in enumerate(pieces.texts) if pieces.weights[i] < 0}, [0.0]
        for end in range(1, len(text) + 2):
            mass.append(float(np.logaddexp.reduce([mass[at] + pieces.weights[ids[p]] for at in range(max(0, end - 16), end) if (p := ("▁" + text)[at:end]) in ids])))
        for _, _, got, lp, _, _ in sample_texts([text], np.array([7], np.uint64), pieces, 4):
            assert lp == pytest.approx(pieces.weights[got].sum() - mass[-1])


def test_without_replacement_frequencies():
    pieces, n = load_pieces(PATH, 8.0), 20_000
    prob = {k: math.exp(v) for k, v in everything("wor", pieces).items()}
    first, second, third, weight = Counter(), Counter(), Counter(), Counter()
    for _, number, ids, lp, _, inclusion in sample_texts(["wor"] * n, np.arange(n).astype(np.uint64), pieces, 3):
        k = tuple(ids.tolist())
        (first, second, third)[number - 1][k] += 1
        weight[k] += math.exp(lp) / inclusion
    close = lambda got, p: abs(got / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-9
    for k, p in prob.items():
        assert close(first[k], p)
        assert close(second[k], sum(q * p / (1 - q) for j, q in prob.items() if j != k))
        assert close(third[k], sum(q * r / (1 - q) * p / (1 - q - r) for i, q in prob.items() for j, r in prob.items() if len({i, j, k}) == 3))
        assert weight[k] / n == pytest.approx(p, rel=0.15)  # weights by inclusion give each segmentation its probability


def test_rows(docs, clashing):
    rows = [(1, "hello world"), (1, "hello world"), (None, None), (2, ""), (3, "x" * 100_000), (4, "hello world")]
    out = sample_segmentations(clashing(rows), PATH, with_ids=True).collect()
    one = [r for r in out if r["doc_id"] == 1]
    assert len(one) == 4 and {r[1:5] for r in one[:2]} == {r[1:5] for r in one[2:]}  # repeated rows alike
    assert [r["perturbed"] for r in out if r["doc_id"] == 4] != [r["perturbed"] for r in one[:2]]
    assert [r["n_pieces"] for r in out if r["doc_id"] in (None, 2)] == [0, 0]
    assert all(len(r["ids"]) == r["n_pieces"] for r in out)
    assert sample_segmentations(docs([]), PATH).count() == 0


def test_samples_don_t_depend_on_the_batch():
    pieces = load_pieces(PATH)
    keys = np.arange(len(TEXTS)).astype(np.uint64) + np.uint64(99)
    together = {(t, n): ids.tolist() for t, n, ids, *_ in sample_texts(TEXTS, keys, pieces, 3)}
    for t, text in enumerate(TEXTS):
        for _, n, ids, *_ in sample_texts([text], keys[t : t + 1], pieces, 3):
            assert together[t, n] == ids.tolist()


def test_decoding_equals_the_library(docs, spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    samples = sample_segmentations(docs(list(enumerate(TEXTS)) + [(50, None), (51, "x" * 20_000)]), PATH, samples=2, with_ids=True)
    rows = samples.select("doc_id", "sample", "ids").collect()
    found = {(r["doc_id"], r["sample"]): r["text"] for r in decode_segmentations(spark.createDataFrame(rows, "doc_id long, sample int, ids array<int>"), PATH).collect()}
    assert len(found) == len(rows) > len(TEXTS)
    for r in rows:
        assert found[r["doc_id"], r["sample"]] == library.decode(r["ids"])
    odd = decode_segmentations(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), PATH).collect()
    assert [(r["doc_id"], r["text"]) for r in odd] == [(1, None), (2, "")]
