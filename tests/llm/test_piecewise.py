import hashlib
import random

import pytest

from logloom.llm import piecewise
from logloom.llm.piecewise import compare_with_next, common_length, edited, fingerprint, fingerprint_likeness, fingerprint_texts, likeness


def slow_hash(window):
    """The rolling hash of one window of seven bytes, by its rule."""
    h = 0
    for v in window:
        h = (h * 0x01000193 + int(piecewise._BYTES[v])) & 0xFFFFFFFF
    h ^= h >> 15
    h = h * 0x045D9F3B & 0xFFFFFFFF
    return h ^ h >> 16


def slow_fingerprint(data):
    """A byte at a time, a block size after the other."""
    hashes = [slow_hash((b"\0" * 6 + data)[i : i + 7]) for i in range(len(data))]

    def signature(k):
        chunks, total, cuts = [], 0, 0
        for i, h in enumerate(hashes):
            total += h
            if h % (1 << k) == (1 << k) - 1 and cuts < 63:
                chunks.append(total)
                total, cuts = 0, cuts + 1
            elif i == len(hashes) - 1:
                chunks.append(total)
        return "".join(piecewise.ALPHABET[int(piecewise.mix(piecewise.np.array([c], "u8"))[0]) >> 58] for c in chunks)

    count = lambda k: sum(h % (1 << k) == (1 << k) - 1 for h in hashes)
    k = 2
    while 64 << k < len(data):
        k += 1
    while k > 2 and count(k) < 31:
        k -= 1
    return f"{1 << k}:{signature(k)}:{signature(k + 1)}"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(1, 9))) for _ in range(n))


@pytest.mark.parametrize("data", [b"", b"a", b"abc def", b"a" * 5000, b"ab" * 4000, words(1, 40).encode(), words(2, 3000).encode(), bytes(range(256)) * 30])
def test_equals_a_byte_at_a_time(data, monkeypatch):
    want = slow_fingerprint(data)
    assert fingerprint(data) == want
    monkeypatch.setattr(piecewise, "BLOCK_BYTES", 97)
    assert fingerprint(data) == want


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_edit_distance_and_likeness():
    r = random.Random(4)
    for _ in range(300):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randint(0, 64))) for _ in range(2))
        assert common_length(a, b) == slow_common(a, b)
    assert likeness("4:abcdefgh:abcd", "4:abcdefgh:abcd") == 1.0
    assert likeness("4:abcdefgh:xyzw", "4:abcdefgx:zzzz") == 2 * 7 / 16
    assert likeness("4:abcdefgh:abcd", "8:abcd:ab") == 1.0 and likeness("8:abcd:ab", "4:abcdefgh:abcd") == 1.0
    assert likeness("4:abcdefgh:abcd", "16:abcdefgh:abcd") == 0.0


def test_like_texts_are_found():
    a, b = words(5, 2000), words(6, 2000)
    one = a.replace(a[3000:3010], "CHANGED", 1)
    own = fingerprint(a.encode())
    assert likeness(own, fingerprint(one.encode())) > 0.9
    assert 0.4 < likeness(own, fingerprint(edited(a, b).encode())) < 0.9
    assert likeness(own, fingerprint(b.encode())) < 0.1


def brute(rows):
    """rows: (id, text) in the order asked for."""
    out = []
    for k, (i, text) in enumerate(rows):
        text, following = text or "", rows[(k + 1) % len(rows)][1] or ""
        own, other, changed = (fingerprint(t.encode()) for t in (text, following, edited(text, following)))
        out.append((i, len(text), hashlib.sha256(edited(text, following).encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, other)))
    return out


def test_rows_meet_the_next(spark, docs, clashing):
    rows = [(i, words(i, 1 + i * 7 % 90)) for i in range(120)] + [(200, None), (201, ""), (202, "é🙂" * 400), (203, "x" * 1_500_000), (None, "last")]
    found = compare_with_next(clashing(rows).repartition(7))
    want = brute(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0))))
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert [tuple(r) for r in compare_with_next(docs([(1, "alone in here")])).collect()] == brute([(1, "alone in here")])
    assert compare_with_next(docs([])).count() == 0


def test_repeated_rows_and_a_hot_id(docs):
    found = compare_with_next(docs([(5, "same words in every row")] * 300 + [(4, "other"), (4, "another")])).collect()
    assert len(found) == 302 and sum(r["near_next"] == 1.0 for r in found if r["doc_id"] == 5) >= 299
    assert len({r["fingerprint"] for r in found if r["doc_id"] == 5}) == 1


def test_columns(docs):
    prints = fingerprint_texts(docs([(1, "hello world"), (2, None), (1, "hello world")]))
    rows = prints.select("doc_id", "n_chars", "fingerprint", fingerprint_likeness(prints["fingerprint"], prints["fingerprint"]).alias("x")).collect()
    assert rows[1]["n_chars"] == 0 and rows[1]["fingerprint"] == "4::" and rows[0] == rows[2] and rows[0]["x"] == 1.0
    assert fingerprint_texts(docs([])).count() == 0
