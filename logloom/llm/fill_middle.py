"""Fill-in-the-middle: prefix, suffix and middle of a text in another order, between sentinels.

One Aho-Corasick automaton goes over a text once and finds events: the sentinels, and the ASCII characters that change
the class of what is around them, such as the blank that ends a word.  Between two events all characters are
of one class, so the units of the gap follow from its length alone.  The events and the units before each of them
are all that is kept of a text; where its k-th unit begins is looked up by rank among them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINELS = ("<P>", "<S>", "<M>")
#: ASCII characters that change the class, by unit.  A code point is a unit in every class, so for `char` none does.
CHANGES = {"char": "", "word": " \t\n\v\f\r", "line": "\n"}
#: Rows are cut in slices of about so many characters.
SLICE_CHARS = 1 << 21


class Ranks(NamedTuple):
    """Starts of runs of units, and the units before each: run r has counts[r + 1] - counts[r] units, each of `size` code
    points, or only one if `size` is 0."""

    starts: list[int]
    counts: list[int]
    size: int
    end: int

    @property
    def total(self) -> int:
        return self.counts[-1]

    def position(self, k: int) -> int:
        """The code point at which unit k begins; the text's end for k = total."""
        if k >= self.total:
            return self.end
        run = bisect_right(self.counts, k) - 1
        return self.starts[run] + (k - self.counts[run]) * self.size


def automaton_of(unit: str, sentinels: tuple[str, ...] = SENTINELS) -> ahocorasick.Automaton:
    """Finds the sentinels and what changes the class; a value's first part tells which, its second the length."""
    out = ahocorasick.Automaton()
    for c in CHANGES[unit]:
        out.add_word(c, ("change", 1))
    for s in sentinels:
        out.add_word(s, ("sentinel", len(s)))
    out.make_automaton()
    return out


def scan(text: str, automaton: ahocorasick.Automaton, unit: str) -> tuple[bool, Ranks]:
    """Whether the text has a sentinel, and the ranks of its units.

    Units: code points (`char`); words with the blanks after them, blanks at the text's beginning being one of their own
    (`word`); lines with their line feed (`line`).
    """
    found, events = False, []
    for last, (kind, _) in automaton.iter(text):
        if kind == "sentinel":
            found = True
        else:
            events.append(last)
    n = len(text)
    if unit == "char":
        return found, Ranks([0], [0, n], 1, n)
    starts = [0] if n else []
    for at, following in zip(events, [*events[1:], n], strict=False):
        # a unit begins after an event, a word only where no other blank follows
        if at + 1 < n and (unit == "line" or following != at + 1):
            starts.append(at + 1)
    return found, Ranks(starts, list(range(len(starts) + 1)), 0, n)


def draws(seed: int, key: object) -> list[int]:
    """Four 32-bit numbers from the SHA-256 of `seed:key`; a null key is empty."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def _slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    sizes, first, total = pc.fill_null(pc.binary_length(column), 0).to_pylist(), 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > SLICE_CHARS:
            yield first, column.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, column.slice(first)


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """One row per row of `df`: id, n, form, prefix_chars, middle_chars, output.

    A text of n units is cut after two numbers of units drawn from `seed` and the row's id.  `psm` is prefix, suffix,
    middle, `spm` suffix, prefix, middle, each after its sentinel; `plain` is the text itself: for `plain_percent` in
    100 rows, for empty texts and for those that contain a sentinel.  prefix_chars and middle_chars count units, null
    for plain ones.

    A null text is an empty one.  A null id draws as an empty key.  Repeated rows are each cut alike; rows of one id draw
    the same numbers.  An empty table gives an empty result.  Other columns of `df` are not looked at.
    """
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, k) for n, k in fields)])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    p, s, m = SENTINELS

    def cut(key: object, text: str, automaton: ahocorasick.Automaton) -> tuple:
        has_sentinel, ranks = scan(text, automaton, unit)
        n = ranks.total
        h1, h2, h3, h4 = draws(seed, key)
        if not text or has_sentinel or h3 % 100 >= 100 - plain_percent:
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = ranks.position(low), ranks.position(high)
        form = "spm" if h4 % 100 < spm_percent else "psm"
        parts = (s, text[b:], p, text[:a], m, text[a:b]) if form == "spm" else (p, text[:a], s, text[b:], m, text[a:b])
        return n, form, low, high - low, "".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(unit)
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                ids = batch.column(0).slice(first, len(texts))
                rows = [cut(i, t or "", automaton) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def restore_text(output: str, form: str, automaton: ahocorasick.Automaton) -> str:
    """The text that `fill_in_middle` made `output` of, by the places of its three sentinels."""
    if form == "plain":
        return output
    at = [(last + 1 - size, last + 1) for last, (kind, size) in automaton.iter(output) if kind == "sentinel"]
    if len(at) != 3:
        raise ValueError(f"{len(at)} sentinels in an output of form {form}")
    parts = [output[a:b] for a, b in zip([x[1] for x in at], [*(x[0] for x in at[1:]), len(output)], strict=True)]
    prefix, suffix = parts[:2] if form == "psm" else parts[1::-1]
    return prefix + parts[2] + suffix


def restore_texts(outputs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of `fill_in_middle`'s result but `output`, and the text rebuilt from output and form alone.  A null
    output or form gives null."""
    rest = [c for c in outputs.columns if c != "output"]
    schema = T.StructType([*(outputs.schema[c] for c in rest), T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of("char")
        for batch in batches:
            forms, column = batch.column("form").to_pylist(), batch.column("output")
            for first, part in _slices(column):
                texts = [None if o is None or f is None else restore_text(o, f, automaton) for o, f in zip(part.to_pylist(), forms[first:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(part)) for c in rest), pa.array(texts, pa.string())], names=schema.names)

    return outputs.mapInArrow(run, schema)


def round_trip(df: DataFrame) -> DataFrame:
    """The digests of what `fill_in_middle` gives for `df` and of the texts rebuilt from it."""
    both = fill_in_middle(df).withColumn("output_sha256", F.sha2("output", 256))
    return restore_texts(both, "restored").select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2("restored", 256).alias("restored_sha256"))


FILL_MIDDLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
         ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
              ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
