"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes cuts a text wherever its low bits are all ones, so the cuts move with the content.
Each chunk gives one character of the signature.  The block size, a power of two, is the largest with
at least 32 chunks; a fingerprint holds the signatures for it and for its double, and two fingerprints are compared where
they have a block size in common, by the edit distance of the signatures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .words import mix

WINDOW = 7
#: Characters of a signature at most; what follows the last cut that counts is one chunk.
LENGTH = 64
#: log2 of the smallest block size.
LEAST = 2
#: Signatures that don't share so many characters in a row are unlike.
SHARED = 4
BLOCK_BYTES = 1 << 18
SLICE_BYTES = 1 << 22

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BYTES = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_STEP, _STIR = np.uint32(0x01000193), np.uint32(0x045D9F3B)


def rolling(values: np.ndarray) -> np.ndarray:
    """A hash of each window of seven bytes."""
    table = _BYTES[values]
    n = len(values) - WINDOW + 1
    out = table[:n].copy()
    for j in range(1, WINDOW):
        out *= _STEP
        out += table[j : j + n]
    out ^= out >> np.uint32(15)
    out *= _STIR
    out ^= out >> np.uint32(16)
    return out


class Cuts:
    """Of one block size: how many cuts there are, and the sum of all hashes up to each of the first."""

    def __init__(self) -> None:
        self.count, self.sums, self.last = 0, [], -1

    def add(self, at: np.ndarray, sums: np.ndarray) -> None:
        self.count += len(at)
        room = LENGTH - 1 - len(self.sums)
        if room > 0 and len(at):
            self.sums += sums[:room].tolist()
            self.last = int(at[:room][-1])

    def signature(self, total: int, n: int) -> str:
        sums = self.sums + ([total] if self.last < n - 1 else [])
        chunks = np.diff(np.array([0, *sums], np.uint64))
        return "".join(ALPHABET[c] for c in (mix(chunks) >> np.uint64(58)).tolist())


def cuts_of(data: np.ndarray, least: int, most: int) -> tuple[dict[int, Cuts], int]:
    """The cuts for the block sizes 2^least to 2^most, and the sum of all hashes; the bytes are read a block at a time."""
    found, total = {k: Cuts() for k in range(least, most + 1)}, np.uint64(0)
    before = np.zeros(WINDOW - 1, np.uint8)
    for first in range(0, len(data), BLOCK_BYTES):
        values = np.concatenate([before, data[first : first + BLOCK_BYTES]])
        before = values[1 - WINDOW :]
        hashes = rolling(values)
        sums = np.cumsum(hashes, dtype=np.uint64) + total
        total = sums[-1]
        at = np.flatnonzero((hashes & np.uint32((1 << least) - 1)) == (1 << least) - 1)
        hashes, sums = hashes[at], sums[at]
        for k in range(least, most + 1):
            if k > least:
                more = np.flatnonzero(hashes & np.uint32(1 << (k - 1)))
                at, hashes, sums = at[more], hashes[more], sums[more]
            if not len(at):
                break
            found[k].add(at + first, sums)
    return found, int(total)


def fingerprint(data: bytes) -> str:
    """`size:signature:signature at twice the size`; equal bytes have equal fingerprints, those of no bytes are `4::`."""
    values = np.frombuffer(data, np.uint8)
    n, top = len(values), LEAST
    while LENGTH << top < n and top < 30:
        top += 1
    least = max(LEAST, top - 3)
    cuts, total = cuts_of(values, least, top + 1)
    if least > LEAST and all(cuts[k].count < LENGTH // 2 - 1 for k in range(least, top + 1)):
        cuts, total = cuts_of(values, LEAST, top + 1)
        least = LEAST
    size = next((k for k in range(top, least, -1) if cuts[k].count >= LENGTH // 2 - 1), least)
    return f"{1 << size}:{cuts[size].signature(total, n)}:{cuts[size + 1].signature(total, n)}"


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of `a`."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        both = row & masks.get(c, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def alike(a: str, b: str) -> float:
    """1 less the share of characters that have to be deleted or inserted; 0 without a shared run of characters."""
    runs = {a[i : i + SHARED] for i in range(len(a) - SHARED + 1)}
    if not any(b[i : i + SHARED] in runs for i in range(len(b) - SHARED + 1)):
        return 0.0
    return 2 * common_length(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 for equal fingerprints, 0 for those without a block size in common."""
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    n, m = int(n), int(m)
    if n == m:
        return max(alike(a1, b1), alike(a2, b2))
    return alike(a2, b1) if m == 2 * n else alike(a1, b2) if n == 2 * m else 0.0


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """`likeness` of two columns of fingerprints; null if one is null."""

    @F.arrow_udf("double")
    def score(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if i is None or j is None else likeness(i, j) for i, j in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return score(a, b)


def slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column in order, some 4 MB at a time, null as empty."""
    sizes, first, total = pc.fill_null(pc.binary_length(column), 0).to_pylist(), 0, 0
    for i, n in enumerate([*sizes, SLICE_BYTES]):
        if i > first and total + n > SLICE_BYTES or i == len(sizes) > first:
            yield first, [t or "" for t in column.slice(first, i - first).to_pylist()]
            first, total = i, 0
        total += n


def fingerprint_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, n_chars, fingerprint of the whole text's UTF-8.

    A null text is an empty one; repeated rows have a row each; an empty table gives an empty result.  Other columns
    of `df` are not looked at.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(texts)), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t.encode()) for t in texts], pa.string())], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The text with the last half of its code points replaced by the first as many of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(text: str, own: str, following: str, next_print: str) -> tuple:
    other = edited(text, following).encode()
    changed = fingerprint(other)
    return len(text), hashlib.sha256(other).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_print)


RESULT = {"n_chars": T.LongType(), "edited_sha256": T.StringType(), "fingerprint": T.StringType(), "edited_fingerprint": T.StringType(), "near_edited": T.DoubleType(), "near_next": T.DoubleType()}
RESULT_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: its fingerprint and how it compares with that of an edited text and of the next text.

    Rows are in the order of descending ids, null ids last, rows of one id by a hash of their text and then by their place;
    the last row's next is the first, so a table's only row is its own next.  The texts are dealt out in ranges of this order, each sorted,
    and read one after the other; only a range's first and last rows, one of each, are paired in a second step.

    A null text is an empty one; repeated rows have a row each; an empty table gives an empty result.  Other columns
    of `df` are not looked at.
    """
    order = [F.desc_nulls_last("id"), "hash", "place"]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("place"))
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), *(T.StructField(n, k) for n, k in RESULT.items())] + [T.StructField("edge", T.StringType()), T.StructField("range", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = number = None

        def edge(kind: str, row: tuple, own: str) -> pa.RecordBatch:
            key, text, hashed = row
            columns = [key, pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([own]), *(pa.nulls(1, k) for k in RESULT_KINDS[3:]), pa.array([kind]), pa.array([number], pa.int64()), hashed, pa.array([text])]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for b in batches:
            for first, texts in slices(b.column("text")):
                prints = [fingerprint(t.encode()) for t in texts]
                ids, hashes = b.column("id").slice(first, len(texts)), b.column("hash").slice(first, len(texts))
                if before is None:
                    number = b.column("place")[first].as_py()
                    yield edge("first", (ids.slice(0, 1), texts[0], hashes.slice(0, 1)), prints[0])
                    found, keys = [], ids.slice(0, len(texts) - 1)
                else:
                    found, keys = [compared(before[0][1], before[1], texts[0], prints[0])], pa.concat_arrays([before[0][0], ids.slice(0, len(texts) - 1)])
                found += [compared(texts[i], prints[i], texts[i + 1], prints[i + 1]) for i in range(len(texts) - 1)]
                before = (ids.slice(len(texts) - 1), texts[-1], hashes.slice(len(texts) - 1)), prints[-1]
                if found:
                    n = len(found)
                    columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), RESULT_KINDS, strict=True)]
                    yield pa.RecordBatch.from_arrays([keys, *columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=schema.names)
        if before is not None:
            yield edge("last", *before)

    done = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "fingerprints")
    inside = done.where("edge is null").select(F.col("id").alias(id_col), *RESULT)

    # The ranges, a row each, in their order; then each one's last row with the next one's first.
    ranges = done.where("edge = 'first'").select("id", "hash", "range")
    whole = Window.orderBy(F.desc_nulls_last("id"), "hash", "range")
    follows = ranges.select("range", F.lead("range").over(whole).alias("next"), F.first("range").over(whole).alias("start"))
    follows = follows.select("range", F.coalesce("next", "start").alias("next"))
    ends = done.where("edge = 'last'").select("id", "range", F.col("text").alias("text"), "fingerprint").join(follows, "range")
    heads = done.where("edge = 'first'").select(F.col("range").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    ends = ends.join(heads, "next").select("id", "text", "fingerprint", "next_text", "next_fingerprint")
    kinds = T.StructType(schema.fields[: 1 + len(RESULT)])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = compared(*(b.column(k)[i].as_py() for k in range(1, 5)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([v], k) for v, k in zip(found, RESULT_KINDS, strict=True))], names=kinds.names)

    return inside.unionByName(ends.mapInArrow(pair, kinds).withColumnRenamed("id", id_col))
