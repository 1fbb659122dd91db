import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm.fill_middle import automaton_of, fill_in_middle, restore_text, restore_texts, round_trip, scan

UNITS = {"char": r"(?s).", "word": r"(?s)^[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", "line": r"(?s)[^\n]*\n|[^\n]+"}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é🙂\n\t <P>SM", max_size=40))
def test_ranks_are_those_of_the_units(text):
    for unit, pattern in UNITS.items():
        found, ranks = scan(text, automaton_of(unit), unit)
        starts = [m.start() for m in re.finditer(pattern, text)]
        assert found == any(s in text for s in ("<P>", "<S>", "<M>"))
        assert [ranks.position(k) for k in range(ranks.total)] == starts and ranks.total == len(starts)
        assert ranks.position(ranks.total) == len(text)


def expected(doc_id, text):
    """The contract, step by step."""
    t = text or ""
    n = len(t)
    x = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    a, b = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_follows_the_contract(docs, clashing):
    texts = ["", None, "a", "é🙂" * 50, "x <P> y", "<P", "<", "S>", "<<<S", "ends with <", "\x00\n ", "z" * 3_000_000]
    rows = [(i, texts[i % len(texts)]) for i in range(150)] + [(7, "again"), (7, "again")]
    found = sorted(fill_in_middle(clashing(rows)).collect(), key=str)
    assert found == sorted([(i, *expected(i, t)) for i, t in rows], key=str)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    for r in round_trip(docs(rows)).collect():
        texts_of = {hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows if i == r["doc_id"]}
        outputs = {hashlib.sha256(expected(i, t)[4].encode()).hexdigest() for i, t in rows if i == r["doc_id"]}
        assert r["restored_sha256"] in texts_of and r["output_sha256"] in outputs
    assert fill_in_middle(docs([])).count() == 0 and round_trip(docs([])).count() == 0


def test_words_and_lines_as_units(docs):
    text = "  one two\tthree\n\nfour  five\n"
    for unit in ("word", "line"):
        pieces = re.findall(UNITS[unit], text)
        out = fill_in_middle(docs([(i, text) for i in range(60)] + [(None, text)]), unit=unit)
        for r in out.where("form <> 'plain'").collect():
            a, b = r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]
            prefix, middle, suffix = ("".join(x) for x in (pieces[:a], pieces[a:b], pieces[b:]))
            assert r["n"] == len(pieces) and r["output"] == (f"<S>{suffix}<P>{prefix}<M>{middle}" if r["form"] == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}")
        assert {r["text"] for r in restore_texts(out).collect()} == {text}


def test_sentinels_at_the_seams():
    a = automaton_of("char")
    assert restore_text("<P><<S>S>P><M><", "psm", a) == "<<S>P>"
