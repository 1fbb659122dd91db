import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from logloom.llm.common import tokenizer
from logloom.llm.packing import Encoder, best_fit, pack, pack_documents, packing_plan, reduce_by_dominance, text_slices, token_pieces

PATH = tokenizer("word_bpe_49k.json")


def sequences(histogram, capacity):
    """The lengths in each sequence of a plan, checked to be gapless and to place every piece."""
    seqs, ranks = {}, Counter()
    for r in packing_plan(histogram, capacity):
        assert r.first_rank == ranks[r.length]
        ranks[r.length] = r.end_rank
        for k in range(r.end_rank - r.first_rank):
            seqs.setdefault(r.sequence + k // r.each, []).append((r.offset + k % r.each * r.length, r.length))
    assert dict(ranks) == {k: v for k, v in histogram.items() if v}
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def fewest(lengths, capacity):
    """By trying everything."""
    best = len(lengths)

    def place(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= rest[0]}.values():
            place(rest[1:], [*rooms[:i], rooms[i] - rest[0], *rooms[i + 1 :]])
        place(rest[1:], [*rooms, capacity - rest[0]])

    place(sorted(lengths, reverse=True), [])
    return best


def decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(150))
def test_reduction_keeps_a_best_packing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 20, 30])
    lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 9))]
    fixed, rest = reduce_by_dominance(Counter(lengths), capacity)
    left = [k for k, v in rest.items() for _ in range(v)]
    assert sum(n for n, _ in fixed) + fewest(left, capacity) == fewest(lengths, capacity)
    assert sequences(Counter(lengths), capacity) <= decreasing(lengths, capacity)


def test_best_fit_over_counts_equals_one_at_a_time():
    for seed in range(100):
        r = random.Random(seed)
        lengths = [r.randint(1, 50) for _ in range(80)]
        assert sum(n for n, _ in best_fit(Counter(lengths), 50)) == decreasing(lengths, 50)


def test_large_histogram_needs_few_runs():
    h = Counter(min(4096, int(random.Random(i).lognormvariate(6, 1.2)) + 1) for i in range(50_000))
    assert sequences(h, 4096) <= -(-sum(k * v for k, v in h.items()) // 4096) * 1.01
    assert len(packing_plan({k: v * 10**6 for k, v in h.items()})) < 60_000


def ids_of(e, texts):
    flat, bounds = e.encode(pa.array(texts, pa.string()))
    return [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def whole_ids(texts):
    plain = Tokenizer.from_file(PATH)
    return [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_shared_strings_give_the_tokenizer_s_ids():
    texts = ["", "Don't STOP it's", "a<|endoftext|>b  x", "İstanbul ΣΑΣ. été… ! ?", "日本語、テスト。 １２３ abc123def", "é. x́!", "tab\tx y z\x1cq", "'S'T're'VE 's", "ﬁ. ½! Ⅷ. x²."]
    texts += ["MEVSİMİ.", "İ.́ J̌. J̌", "\x1c", "a\x1fb", "x.\x00.", "a.\r\nb,\n\nc", "ÀÉ?! ÿ* Ÿ*", "K. Å#", "a;̧ b", "<|startoftext|>. <|", "5.5, 5., .5"]
    e = Encoder(PATH)
    assert ids_of(e, texts) == whole_ids(texts) == ids_of(e, texts)


def test_every_ascii_character_as_the_tokenizer_has_it():
    texts = [form.replace("?", chr(c)) for c in range(128) for form in ("a?b", "1?2", "a ? b", "x.??.y", "?'s", "?", "É?.", "a?̈")]
    assert ids_of(Encoder(PATH), texts) == whole_ids(texts)


def test_random_strings_as_the_tokenizer_has_them():
    r = random.Random(3)
    signs = "aZéÉßİıΣσςJKÅ ̧̌̇́.,!?:;|*%$#&'\"<|>sStTmMdD019½Ⅷ²日テ\x1c\x1f\x85\xa0\u2028\u3000\t\n\x00\u200d🙂"
    texts = ["".join(r.choice(signs) for _ in range(r.randint(1, 7))) for _ in range(20_000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0x250), r.randrange(0x300, 0x380), r.randrange(0x1E00, 0x2000)])) for _ in range(4)) for _ in range(20_000)]
    assert ids_of(Encoder(PATH), texts) == whole_ids(texts)


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr("logloom.llm.packing.REMEMBERED_BYTES", 4000)
    r, e = random.Random(5), Encoder(PATH)
    for _ in range(30):
        texts = [" ".join("".join(r.choice("abcdE.") for _ in range(r.randint(0, 6))) for _ in range(20)) for _ in range(3)]
        assert ids_of(e, texts) == whole_ids(texts)
        assert e.strings.nbytes + e.flat.nbytes + e.ends.nbytes < 4000 + 6000


def test_long_texts_are_slices_of_their_own():
    texts = pa.array(["ab", None, "c" * 50, "", "d"])
    assert [(k, t.to_pylist()) for k, t in text_slices(texts, 10)] == [(0, ["ab", None]), (2, ["c" * 50]), (3, ["", "d"])]
    assert list(text_slices(texts.slice(0, 0))) == []


def test_documents(spark, docs, clashing):
    long = "word " * 9000
    rows = [(1, "hello world"), (2, long), (3, None), (4, ""), (None, "x"), (1, "hello world"), *((10 + i, "same text here") for i in range(500))]
    out = [r.asDict() for r in pack_documents(clashing(rows), PATH).collect()]
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    seqs = {}
    for r in out:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seqs) == -(-sum(r["length"] for r in out) // 4096)
    assert pack_documents(docs([]), PATH).count() == 0


def test_ranks_are_dealt_out(spark):
    pieces = spark.range(200).selectExpr("id doc_id", "0 piece", "id % 3 + 1 length")
    assert len({(r["sequence_id"], r["offset"]) for r in pack(pieces, 10).collect()}) == 200


def test_ids_on_request(docs):
    r = token_pieces(docs([(1, "hello")]), PATH, with_ids=True).first()
    assert np.frombuffer(r["ids"], "<u4")[-1] == 1 and r["length"] == len(r["ids"]) // 4


def test_added_tokens_in_any_case():
    """The tokenizer looks for them as they are written, before it lower-cases."""
    r, encode, whole = random.Random(8), Encoder(PATH).encode, Tokenizer.from_file(PATH)
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    assert added
    parts = ["a", "Word", "ÉTÉ", "'s", "!", "12", "<", "|", "🙂", ">", ".", "", "", ""]
    cased = lambda t: r.choice([t, t.upper(), t.title(), t.swapcase(), "".join(r.choice((c, c.upper())) for c in t)])
    texts = [" ".join("".join(cased(r.choice(added)) if r.random() < 0.4 else r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 6))) for _ in range(20_000)]
    flat, at = encode(pa.array(texts))
    want = [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    wrong = [t for k, t in enumerate(texts) if flat[at[k] : at[k + 1]].tolist() != want[k]]
    assert not wrong, wrong[:5]
