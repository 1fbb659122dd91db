"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Only lengths matter for packing, and there are at most `capacity` different ones.
So the plan is made from their histogram, whose size does not depend on the number
of documents, and says for each run of equally long pieces which sequences they go
to.  The pieces themselves stay distributed: each gets a rank among the pieces of
its length, from counts by length and chunk, and looks its rank up in the plan.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

CAPACITY = 4096
END_ID = 1
#: Bytes of remembered strings and their ids in a worker, after which it starts anew.
REMEMBERED_BYTES = 64 << 20
#: Bytes of text that are tokenised together, and new strings that the tokenizer gets at once.
SLICE_BYTES = 4 << 20
NEW_STRINGS = 20_000


# ---------------------------------------------------------------- tokens


class Encoder:
    """Ids of whole texts, for a tokenizer that drops white space, never joins across it and marks words' ends.
    So only each different string between blanks is tokenised, and what came of it is remembered within a bound of bytes.

    Two more things save work, neither of which the tokenizer can tell: capitals of strings that have only ASCII and
    the letters of Latin-1 are lower-cased first, as the tokenizer does, and marks at a string's end, after such a
    letter or a digit, are a string of their own.  Strings with an added token, which the tokenizer looks for before
    it lower-cases, in any case are left as they are.
    """

    LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    #: Characters that compose and change case alone, whatever stands beside them.
    SIMPLE = f"^[\x00-\x7f{LETTERS}]*$"
    MARKS = ".,!?:;|*%$#&"
    MARKED = f"[{LETTERS}0-9][{MARKS}]+$"
    WORD = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for words that nothing would split.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        #: Ids that end a word: each of these words has one, its last.
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.strings = pa.array([], pa.large_string())
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _tokenise(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The strings' ids one after the other, and how many each has."""
        plain = pc.match_substring_regex(strings, self.WORD).to_numpy(zero_copy_only=False)
        flat, owner = [], []
        for words in (True, False):
            chosen = np.flatnonzero(plain == words)
            for first in range(0, len(chosen), NEW_STRINGS):
                part = chosen[first : first + NEW_STRINGS]
                texts = strings.take(pa.array(part)).to_pylist()
                if words:
                    found = self.words.encode_batch_fast([texts], add_special_tokens=False, is_pretokenized=True)[0]
                    flat.append(np.array(found.ids, np.uint32))
                    owner.append(np.repeat(part, np.diff(np.flatnonzero(self.closes[flat[-1]]), prepend=-1)))
                else:
                    ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                    flat.append(np.array([i for one in ids for i in one], np.uint32))
                    owner.append(np.repeat(part, [len(one) for one in ids]))
        if not flat:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, owners = np.concatenate(flat), np.concatenate(owner)
        return ids[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(strings))

    def _known(self, strings: pa.Array) -> np.ndarray:
        """The number of each of these different strings among those remembered, after tokenising the new ones."""
        if self.strings.nbytes + self.flat.nbytes + self.ends.nbytes > REMEMBERED_BYTES:
            self._forget()
        at = pc.index_in(strings, value_set=self.strings)
        new = strings.filter(at.is_null())
        ids, count = self._tokenise(new)
        out = at.fill_null(-1).to_numpy().astype(np.int64)
        out[out < 0] = len(self.strings) + np.arange(len(new))
        self.strings = pa.concat_arrays([self.strings, new])
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(count)])
        return out

    def _parts(self, strings: pa.Array) -> pa.Array:
        """Each string's core and its tail, which may be empty, one after the other."""
        free = pa.array(np.ones(len(strings), bool))
        for token in self.added:
            free = pc.and_not(free, pc.match_substring(strings, token, ignore_case=True))
        simple = pc.and_(free, pc.match_substring_regex(strings, self.SIMPLE))
        strings = pc.if_else(simple, pc.utf8_lower(strings), strings)
        cut = pc.and_(free, pc.match_substring_regex(strings, self.MARKED))
        core = pc.if_else(cut, pc.utf8_rtrim(strings, self.MARKS), strings)
        _, offsets, data = strings.buffers()
        at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
        bounds = np.append(np.stack([at[:-1], at[:-1] + pc.binary_length(core).to_numpy()], 1).ravel(), at[-1])
        return pa.Array.from_buffers(pa.large_string(), 2 * len(strings), [None, pa.py_buffer(bounds), data])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' ids one after the other, and where each text's begin, with the end of the last."""
        texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        strings = lists.flatten().dictionary_encode()
        parts = self._parts(strings.dictionary).dictionary_encode()
        known = self._known(parts.dictionary)
        # The ids of each different string, and then those of each string of the texts.
        flat, ends = _gather(self.flat, self.ends, known[parts.indices.to_numpy()])
        flat, ends = _gather(flat, ends[::2], strings.indices.to_numpy())
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return flat, ends[offsets]


def _gather(flat: np.ndarray, ends: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `chosen` of `flat`, the k-th of which goes from ends[k] to ends[k + 1], one after the other."""
    size = (ends[1:] - ends[:-1])[chosen]
    out = np.append(0, np.cumsum(size))
    return flat[np.repeat(ends[:-1][chosen] - out[:-1], size) + np.arange(out[-1])], out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def text_slices(texts: pa.Array, most_bytes: int = SLICE_BYTES):
    """(first row, texts) of consecutive rows with at most so many bytes; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield first, texts.slice(first, last - first)
        first = last


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Each text's ids, then the end id, in pieces of `capacity`, the last one shorter.

    Columns: id, piece (from 0), start, length, ids_crc32 and, if asked for, ids.
    A null or empty text is the end id alone.
    """
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
        + [T.StructField("ids", T.BinaryType())] * with_ids
    )
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer).encode
        for b in batches:
            for first, texts in text_slices(b.column(1)):
                flat, bounds = encode(texts)
                rows = []
                for i, (start, stop) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    ids = flat[start:stop].astype("<u4").tobytes() + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((first + i, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                columns = list(zip(*rows, strict=True))
                arrays = [b.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(columns[k], pa.int64()) for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns[5], pa.binary())] * with_ids, names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


# ---------------------------------------------------------------- plan


class Run(NamedTuple):
    """Pieces `first_rank` <= rank < `end_rank` of one length: `each` of them side by side in each of consecutive
    sequences, from `offset` on."""

    length: int
    first_rank: int
    end_rank: int
    sequence: int
    each: int
    offset: int


Content = tuple[tuple[int, int], ...]  # (length, how many) side by side


class _Lengths:
    """Counts of the lengths left, with the different ones in order."""

    def __init__(self, histogram: dict[int, int]):
        self.count = {k: v for k, v in histogram.items() if v > 0}
        self.order = sorted(self.count)

    def give(self, length: int) -> None:
        if length not in self.count:
            insort(self.order, length)
        self.count[length] = self.count.get(length, 0) + 1

    def take(self, length: int, n: int) -> None:
        if n == 0:
            return
        self.count[length] -= n
        if not self.count[length]:
            del self.count[length]
            del self.order[bisect_left(self.order, length)]

    def largest(self, room: int) -> int | None:
        k = bisect_right(self.order, room)
        return self.order[k - 1] if k else None

    def smallest(self, n: int) -> int | None:
        """Sum of the n smallest pieces, None if there are fewer."""
        total = 0
        for length in self.order:
            take = min(n, self.count[length])
            total, n = total + take * length, n - take
            if not n:
                return total
        return None

    def pair_over(self, least: int, most: int) -> bool:
        """Whether two pieces together are longer than `least` and at most `most`."""
        low, high = 0, bisect_right(self.order, most) - 1
        while low <= high:
            a, b = self.order[low], self.order[high]
            if a + b > most or low == high and self.count[a] < 2:
                high -= 1
            elif a + b > least:
                return True
            else:
                low += 1
        return False


def reduce_by_dominance(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, Content]], dict[int, int]]:
    """Sequences that some best packing has, as (how many, content), and the lengths that are left.

    For the longest piece j: it stands alone if nothing fits beside it; with k if k
    fills the room exactly; with the largest fitting k if only one piece fits; and
    also if at most two fit and no fitting pair is longer than k, since k can then
    change places with the pair.  Any other j is left for best fit.
    """
    left, fixed = _Lengths(histogram), []
    for j in reversed(list(left.order)):
        while n := left.count.get(j, 0):
            left.take(j, 1)  # look for companions among the others
            room = capacity - j
            k = left.largest(room)
            if k is None:
                content: Content = ((j, 1),)
                times = n if 2 * j > capacity else 1
            else:
                two, three = left.smallest(2), left.smallest(3)
                if not (k == room or two is None or two > room or ((three is None or three > room) and not left.pair_over(k, room))):
                    left.give(j)
                    break
                content = ((j, 2),) if k == j else ((j, 1), (k, 1))
                times = n // 2 if k == j else min(n, left.count[k])
            fixed.append((times, content))
            for length, each in content:
                left.take(length, times * each - (length == j))
    return fixed, left.count


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, Content]]:
    """Best-fit decreasing over counts: each piece goes where the least room is left."""
    rooms: list[int] = []
    by_room: dict[int, list[list]] = {}

    def put(room: int, count: int, content: Content) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append([count, content])

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                whole, part = divmod(n, each)
                if whole:
                    put(capacity - each * length, whole, ((length, each),))
                if part:
                    put(capacity - part * length, 1, ((length, part),))
                break
            room = rooms[k]
            group = by_room[room][-1]
            each = room // length
            whole = min(group[0], n // each)
            part = n if whole == 0 and n < each else 0
            used = whole or 1
            group[0] -= used
            if not group[0]:
                by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    del rooms[k]
            placed = part or each
            put(room - placed * length, used, (*group[1], (length, placed)))
            n -= used * placed
    return [(count, content) for groups in by_room.values() for count, content in groups]


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    fixed, rest = reduce_by_dominance(histogram, capacity)
    plan, rank, sequence = [], Counter(), 0
    for times, content in fixed + best_fit(rest, capacity):
        offset = 0
        for length, each in content:
            plan.append(Run(length, rank[length], rank[length] + times * each, sequence, each, offset))
            rank[length] += times * each
            offset += length * each
        sequence += times
    return plan


# ---------------------------------------------------------------- packing


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """`pieces` with sequence_id and offset: no sequence is longer than `capacity`, and each is gapless from 0.

    `length` must be from 1 to `capacity`.  Rows with equal keys are ranked in any
    order, so repeated rows get places of their own.  An empty table stays empty.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = packing_plan(histogram, capacity)
    # At most `capacity` rows, whatever the number of pieces.  Of n pieces of one length, about the root of n are
    # ranked in a group, and as many groups have their bases summed up.
    chunks = spark.createDataFrame([(k, math.isqrt(n - 1) + 1) for k, n in histogram.items()], "length long, _chunks long")
    dealt = pieces.join(F.broadcast(chunks), "length").withColumn("_chunk", F.pmod(F.xxhash64(*keys), F.col("_chunks")))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "_chunk").count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_chunk").orderBy(*keys)) - 1)
    ranked = ranked.join(bases, ["length", "_chunk"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    runs = spark.createDataFrame(plan or [Run(0, 0, 0, 0, 1, 0)], "_length long, _from long, _to long, _sequence long, _each long, _offset long")
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    at = F.col("_rank") - F.col("_from")
    # The plan has a few rows for each length, whatever the number of pieces.
    return ranked.join(F.broadcast(runs), inside).select(*pieces.columns, (F.col("_sequence") + F.floor(at / F.col("_each"))).alias("sequence_id"), (F.col("_offset") + (at % F.col("_each")) * F.col("length")).alias("offset"))


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Per piece of each row of `df`: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece of length 1; repeated rows are packed each;
    other columns are not looked at; an empty table gives an empty result.
    """
    return pack(written(token_pieces(df, tokenizer, id_col, text_col, capacity), "pieces"), capacity, (id_col, "piece"))
