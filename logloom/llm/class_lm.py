"""Language-model scoring with class-based n-grams (Brown).

Words belong to classes; a token's probability is that of its class after the class
before it, times that of the word in its class.  The classes come from exchange
clustering: every word moves to the class that gives the training bigrams the highest
likelihood.  The most frequent words (`CORE_WORDS`) move one at a time, until none
does.  Then all words that tasks know (`FREQUENT`) move in distributed sweeps (Uszkoreit and
Brants, 2008, distribute the exchange alike): each word's best class is found against the classes as
they are, and a share of those that would move, chosen by hash, does.  A sweep that lowers the likelihood is
taken back and a smaller share moves, and sweeps go on until few words would move.  Each word's neighbours are written once, so
that a sweep is a map over them and shuffles nothing.  Words still rarer move in groups, by
their last bytes and length.

Counts are over all training texts.  The word and bigram counts grow with the corpus
and stay distributed: only the most frequent words, a fixed number, are sent to every
task, and rarer tokens find their counts by a join on the word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import among_top, written
from .words import Words, mix, word_chunks

#: Words that are clustered one by one to begin with, groups of the rarest, classes.
CORE_WORDS = 800
GROUPS = 200
CLASSES = 48
#: Words whose counts and classes every task holds: 17 bytes each.
FREQUENT = 1 << 18
#: Sweeps end when fewer than this share of the symbols would move, or not even the smallest share of those can.  In the first
#: sweep all may move; later, when neighbours move to and fro together, half of them come to rest sooner.
MOVES_LEFT = 0.02
SHARES = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Entries of a block of neighbours, 12 bytes each; a word's entries stay together.
BLOCK_ENTRIES = 1 << 15
#: Bytes of text that are split into words at once.
CHUNK_BYTES = 1 << 20
#: Pairs that a task gathers before it sums them, and about so many that a part has at most.
WAITING, PART_ENTRIES = 1 << 19, 1 << 21
#: Counts up to this are looked up when gains are computed.
SMALL = 64
END = 0  # the hash of the token that ends a text
#: Share of the class-transition probability that comes from the class's own frequency.
BACK_OFF = 0.05


class Symbols(NamedTuple):
    """What the classes are made over: symbol 0 is the end, then words, then groups of the other words."""

    words: np.ndarray  # sorted hashes
    groups: int

    @property
    def size(self) -> int:
        return 1 + len(self.words) + self.groups

    def of(self, words: Words) -> np.ndarray:
        """The symbol of every word."""
        out = 1 + len(self.words) + word_groups(words, self.groups)
        at, known = places(self.words, words.hashes)
        out[known] = 1 + at[known]
        return out


def places(values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of `wanted` is among the sorted `values`, and whether it is there."""
    at = np.minimum(np.searchsorted(values, wanted), max(len(values) - 1, 0))
    return at, values[at] == wanted if len(values) else np.zeros(len(wanted), bool)


def word_groups(words: Words, groups: int) -> np.ndarray:
    """The group of every word: by its last bytes and its length."""
    size = words.ends - words.starts
    last = words.data[words.ends - 1].astype(np.int64)
    before = np.where(size > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 7 + np.minimum(size, 24) // 4) % groups


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """(word, group, n) over all texts; a word is its 64-bit hash."""

    def run(batches):
        found, waiting = [], 0
        for b in batches:
            for w in word_chunks(b.column(0), CHUNK_BYTES):
                word, at, n = np.unique(w.hashes, return_index=True, return_counts=True)
                found.append((word, word_groups(w, GROUPS)[at].astype(np.int32), n))
                waiting += len(word)
                if waiting > WAITING:
                    yield told(found)
                    found, waiting = [], 0
        if found:
            yield told(found)

    def told(found):
        word, group, n = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        word, group, n = word[order], group[order], n[order]
        new = np.ones(len(word), bool)
        new[1:] = word[1:] != word[:-1]
        starts = np.flatnonzero(new)
        n = np.add.reduceat(n, starts) if len(starts) else n
        return pa.RecordBatch.from_arrays([pa.array(signed(word[starts])), pa.array(group[starts]), pa.array(n.astype(np.int64))], names=["word", "group", "n"])

    return df.select(text_col).mapInArrow(run, "word long, group int, n long").groupBy("word", "group").agg(F.sum("n").alias("n"))


def summed(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs in order, and the sum of each one's counts."""
    pair, n = np.concatenate([np.zeros(0, np.int64), *pairs]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[starts], np.add.reduceat(n, starts) if len(starts) else n


def dealt(symbols: np.ndarray, columns: list[np.ndarray], parts: int, names: list[str]):
    """A row for each part, with the entries of its symbols as bytes: what is shuffled is a few long rows."""
    part = (mix(symbols.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    bounds = [*starts.tolist(), len(part)]
    if len(starts):
        packed = [pa.array([c[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(part[starts]), *packed], names=names)


def symbol_bigrams(df: DataFrame, text_col: str, symbols: Symbols, parts: int) -> DataFrame:
    """(part, pairs, counts), numpy arrays as bytes: counts of symbol pairs (left * size + right), those of a left symbol in one part,
    summed as far as a task has read.  A text begins and ends with the end symbol."""
    size, shared = symbols.size, df.sparkSession.sparkContext.broadcast(symbols)

    def run(batches):
        pairs, counts, waiting = [], [], 0
        for b in batches:
            for w in word_chunks(b.column(0), CHUNK_BYTES):
                left, right = with_ends(shared.value.of(w), w.bounds)
                pair, n = np.unique(left * size + right, return_counts=True)
                pairs.append(pair)
                counts.append(n)
                waiting += len(pair)
                if waiting > WAITING:
                    pair, n = summed(pairs, counts)
                    yield from dealt(pair // size, [pair, n], parts, ["part", "pairs", "counts"])
                    pairs, counts, waiting = [], [], 0
        pair, n = summed(pairs, counts)
        yield from dealt(pair // size, [pair, n], parts, ["part", "pairs", "counts"])

    return df.select(text_col).mapInArrow(run, "part int, pairs binary, counts binary")


def neighbour_blocks(bigrams: DataFrame, size: int, parts: int) -> DataFrame:
    """(symbols, sizes, others, counts), numpy arrays as bytes: each symbol's neighbours, 2 * right or 2 * left + 1, and how often.

    A symbol has at most two entries for each other one, so none is more than a few blocks.
    """

    def sides(batches):
        pairs, counts, waiting = [], [], 0
        for b in batches:
            for packed, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                pairs.append(np.frombuffer(packed, np.int64))
                counts.append(np.frombuffer(n, np.int64))
                waiting += len(pairs[-1])
                if waiting > WAITING:
                    pair, n = summed(pairs, counts)
                    pairs, counts, waiting = [pair], [n], 0
        pair, n = summed(pairs, counts)
        left, right = (pair // size).astype(np.int32), (pair % size).astype(np.int32)
        names = ["part", "symbols", "others", "counts"]
        for first in range(0, len(pair), WAITING):
            here = slice(first, first + WAITING)
            yield from dealt(left[here], [left[here], right[here] * 2, n[here]], parts, names)
            yield from dealt(right[here], [right[here], left[here] * 2 + 1, n[here]], parts, names)

    def blocks(batches):
        columns = [[np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]]
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                for c, x, kind in zip(columns, row, (np.int32, np.int32, np.int64), strict=True):
                    c.append(np.frombuffer(x, kind))
        symbol, other, n = (np.concatenate(c) for c in columns)
        order = np.argsort(symbol, kind="stable")
        symbol, other, n = symbol[order], other[order], n[order]
        starts = np.flatnonzero(np.diff(symbol, prepend=-1))
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + BLOCK_ENTRIES, "right")) - 1)
            end = int(starts[last]) if last < len(starts) else len(symbol)
            here = slice(int(starts[first]), end)
            arrays = [symbol[starts[first:last]], np.diff(np.append(starts[first:last], end)).astype(np.int32), other[here], n[here]]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in arrays], names=["symbols", "sizes", "others", "counts"])
            first = last

    both = bigrams.repartition(parts, "part").mapInArrow(sides, "part int, symbols binary, others binary, counts binary")
    return both.repartition(parts, "part").mapInArrow(blocks, "symbols binary, sizes binary, others binary, counts binary")


def unpacked(batches):
    """(symbols, sizes, others, counts) of blocks."""
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield tuple(np.frombuffer(x, kind) for x, kind in zip(row, (np.int32, np.int32, np.int32, np.int64), strict=True))


def class_table(blocks: DataFrame, classes: np.ndarray, kinds: int) -> np.ndarray:
    """Counts of pairs of classes, from those of symbols; a task sends one table's entries."""
    shared = blocks.sparkSession.sparkContext.broadcast(classes.astype(np.int32))

    def run(batches):
        total, of = np.zeros(kinds * kinds), shared.value
        for symbols, sizes, others, counts in unpacked(batches):
            right = np.flatnonzero(others % 2 == 0)
            total += np.bincount(np.repeat(of[symbols], sizes)[right].astype(np.int64) * kinds + of[others[right] // 2], counts[right], kinds * kinds)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    rows = blocks.mapInArrow(run, "pair long, n double").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(kinds * kinds)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(kinds, kinds)


def information(table: np.ndarray) -> float:
    """The mutual information of a class and the next."""
    total = max(table.sum(), 1.0)
    return float((entropy(table).sum() - entropy(table.sum(0)).sum() - entropy(table.sum(1)).sum()) / total + np.log(total))


def entropy(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_classes(symbols: np.ndarray, sizes: np.ndarray, others: np.ndarray, counts: np.ndarray, of: np.ndarray, table: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class in which each symbol of a block gives the training bigrams the highest likelihood while all others stay, and its gain
    over the one it is in.  small: `small_gains` of the table."""
    kinds, rows = len(table), len(symbols)
    beside = np.concatenate([table.T, table])  # by side and the neighbour's class: its counts with each class
    key = np.repeat(np.arange(rows, dtype=np.int64), sizes) * (2 * kinds) + (others & 1) * kinds + of[others >> 1]
    sums = np.bincount(key, counts, rows * 2 * kinds)
    at = np.flatnonzero(sums)
    n, row, slot, own = sums[at], at // (2 * kinds), at % (2 * kinds), of[symbols]
    more = np.empty((len(at), kinds))
    few = n <= SMALL
    more[few] = small[n[few].astype(np.int64), slot[few]]
    base = beside[slot[~few]]
    more[~few] = entropy(base + n[~few, None]) - entropy(base)
    # where the symbol is now, its own counts are in the table
    there = beside[slot, own[row]]
    more[np.arange(len(at)), own[row]] = entropy(there) - entropy(np.maximum(there - n, 0))
    gain = np.add.reduceat(more, np.flatnonzero(np.diff(row, prepend=-1)))
    totals = sums.reshape(rows, 2, kinds).sum(2)
    for side in (0, 1):
        of_class, total = table.sum(1 - side), totals[:, side]
        out = entropy(of_class + total[:, None]) - entropy(of_class)
        now = of_class[own]
        out[np.arange(rows), own] = entropy(now) - entropy(np.maximum(now - total, 0))
        gain -= out
    gain[:, 0] = -np.inf  # the end's
    best = gain.argmax(1)
    return best, gain[np.arange(rows), best] - gain[np.arange(rows), own]


def small_gains(table: np.ndarray) -> np.ndarray:
    """(count, side and neighbour's class, class): what adding a small count to a table's entry adds to its entropy."""
    beside = np.concatenate([table.T, table])
    return np.stack([entropy(beside + c) - entropy(beside) for c in range(SMALL + 1)])


def moves(blocks: DataFrame, classes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, classes): those that would move, given the classes of all others as they are."""
    shared = blocks.sparkSession.sparkContext.broadcast((classes.astype(np.int32), table))

    def run(batches):
        of, t = shared.value
        small = small_gains(t)
        for block in unpacked(batches):
            best, gain = best_classes(*block, of, t, small)
            go = (block[0] > 0) & (gain > 1e-9 * max(1.0, t.sum()) ** 0.5)
            yield pa.RecordBatch.from_arrays([pa.array(block[0][go]), pa.array(best[go].astype(np.int32))], names=["symbol", "class"])

    found = blocks.mapInArrow(run, "symbol int, class int").toArrow()
    return found["symbol"].to_numpy(), found["class"].to_numpy()


def swept_classes(blocks: DataFrame, classes: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(classes, their table) after sweeps, each of which adds to the mutual information."""
    table, share, turn = class_table(blocks, classes, kinds), 0, 0
    symbols, to = moves(blocks, classes, table)
    while len(symbols) > MOVES_LEFT * len(classes) and share < len(SHARES):
        turn += 1
        chosen = mix(symbols.astype(np.uint64) + (np.uint64(turn) << np.uint64(32))) >> np.uint64(32) < int(SHARES[share] * 2**32)
        new = classes.copy()
        new[symbols[chosen]] = to[chosen]
        new_table = class_table(blocks, new, kinds)
        if information(new_table) <= information(table):
            share += 1
            continue
        classes, table, share = new, new_table, max(share, 1)
        symbols, to = moves(blocks, classes, table)
    return classes, table


def with_ends(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbours in texts that the end symbol surrounds."""
    texts = len(bounds) - 1
    place = np.arange(len(symbols)) + np.repeat(np.arange(texts), np.diff(bounds)) + 1
    line = np.zeros(len(symbols) + texts + 1, np.int64)
    line[place] = symbols
    return line[:-1], line[1:]


def exchange_classes(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """The class of every symbol, by moves one at a time until none raises the likelihood; the end has class 0 to
    itself.  Words start dealt by frequency."""
    size = len(bigrams)
    freq = bigrams.sum(0) + bigrams.sum(1)
    cls = np.zeros(size, np.int64)
    order = np.argsort(-freq[1:], kind="stable") + 1
    if classes < 2 or size < 2:
        return cls
    cls[order] = 1 + np.arange(size - 1) % (classes - 1)
    counts = bigrams.astype(float)

    member = np.zeros((size, classes))
    member[np.arange(size), cls] = 1
    after, before = counts @ member, member.T @ counts  # (symbol, class), (class, symbol)
    table = member.T @ after
    left, right = counts.sum(1), counts.sum(0)
    least, moved = 1e-9 * max(1.0, float(entropy(counts.sum()))), 1  # well over what rounding makes of equal gains
    while moved:
        moved = 0
        for w in order:
            if not left[w] and not right[w]:
                continue
            a, own = cls[w], counts[w, w]
            out, into = after[w].copy(), before[:, w].copy()
            out[a] -= own
            into[a] -= own
            base = table.copy()
            base[a] -= out
            base[:, a] -= into
            base[a, a] -= own
            # All tokens before and after w stay in their rows and columns, whatever its class.
            rows, columns = base.sum(1) + into, base.sum(0) + out
            # The gain of adding w to class k to the tables without it.
            gain = (entropy(base + out) - entropy(base)).sum(1) + (entropy(base.T + into) - entropy(base.T)).sum(1)
            diagonal = np.diag(base)
            gain += entropy(diagonal + out + into + own) - entropy(diagonal + out) - entropy(diagonal + into) + entropy(diagonal)
            gain -= entropy(rows + left[w]) - entropy(rows) + entropy(columns + right[w]) - entropy(columns)
            gain[0] = -np.inf
            k = int(np.argmax(gain))
            if k != a and gain[k] > gain[a] + least:
                cls[w] = k
                moved += 1
                after[:, a] -= counts[:, w]
                after[:, k] += counts[:, w]
                before[a] -= counts[w]
                before[k] += counts[w]
                table = base
                table[k] += out
                table[:, k] += into
                table[k, k] += own
    return cls


class Model(NamedTuple):
    symbols: Symbols  # its words are the frequent ones
    classes: np.ndarray  # of symbols
    transition: np.ndarray  # log10 P(class | class before)
    emission: np.ndarray  # -log10 of the class's token and type counts: log10(c + 1) is added per token
    counts: np.ndarray  # of the frequent words
    tokens: int
    types: int


def held_out(id_col: str = "doc_id", parts: int = 7, part: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def train(df: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model and the table (word, n) of the words that it doesn't hold, which is written to the shared folder."""
    counts = written(count_words(df, text_col), "word-counts")
    texts, (tokens, types) = df.count(), counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = among_top(counts, "n", FREQUENT, "word")
    top = counts.where(frequent).toArrow()
    word, group, n = (top[c].to_numpy() for c in ("word", "group", "n"))
    order = np.argsort(word.view(np.uint64))
    word, group, n = word.view(np.uint64)[order], group[order].astype(np.int64), n[order]

    # The core's words one at a time, with groups for all others.
    core = np.sort(np.lexsort((word, -n))[:CORE_WORDS])
    symbols, few = Symbols(word, GROUPS), Symbols(word[core], GROUPS)
    entries = min(int(tokens) + texts, symbols.size**2)  # of different pairs at most
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * entries // PART_ENTRIES))
    blocks = written(neighbour_blocks(symbol_bigrams(df, text_col, symbols, parts), symbols.size, parts), "neighbours")
    to_core = 1 + len(core) + np.concatenate([[0], group, np.arange(GROUPS)])
    to_core[0] = 0
    to_core[1 + core] = 1 + np.arange(len(core))
    start = exchange_classes(class_table(blocks, to_core, few.size), CLASSES)
    # Then all of them, from the class of their group on.
    classes, table = swept_classes(blocks, start[to_core], CLASSES)
    return finish(symbols, classes, table, n, int(tokens) + texts, int(types) + (texts > 0), class_types(counts, group, symbols, classes)), counts.where(~frequent)


def class_types(counts: DataFrame, known_groups: np.ndarray, symbols: Symbols, classes: np.ndarray) -> np.ndarray:
    """How many different training words each class has: the words of the symbols, and the others by group."""
    others = np.zeros(symbols.groups, np.int64)
    for r in counts.groupBy("group").count().collect():  # a row for each group
        others[r["group"]] = r["count"]
    others -= np.bincount(known_groups, minlength=symbols.groups)
    n = len(symbols.words)
    return np.bincount(classes[1 : n + 1], minlength=CLASSES) + np.bincount(classes[n + 1 :], others, CLASSES)


def finish(symbols: Symbols, classes: np.ndarray, table: np.ndarray, counts: np.ndarray, tokens: int, types: int, types_of: np.ndarray) -> Model:
    """Smoothed probabilities: add-one transitions backed off to the classes' own frequency, add-one emissions
    with one place in each class for words never seen."""
    to = table.sum(0)
    own = (to + 1) / (to.sum() + len(to))
    rows = table.sum(1, keepdims=True)
    transition = (1 - BACK_OFF) * (table + 1) / (rows + len(to)) + BACK_OFF * own
    types_of = types_of.copy()
    types_of[0] = 1
    emission = -np.log10(to + types_of + 1)
    return Model(symbols, classes, np.log10(transition), emission, counts, tokens, types)


def score(df: DataFrame, model: Model, counts: DataFrame, end_count: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `df`: id, n_tokens, n_known, train_tokens, base_score, score; `counts` has the words not in the model."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in ("n_tokens", "known")] + [T.StructField(c, T.DoubleType()) for c in ("logs", "classes")] + [T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches):
        m = shared.value
        for b in batches:
            for w in word_chunks(b.column(1), CHUNK_BYTES):
                n, per = w.last - w.first, np.diff(w.bounds)
                text = np.repeat(np.arange(n), per)
                left, right = with_ends(m.classes[m.symbols.of(w)], w.bounds)
                owner = np.repeat(np.arange(n), per + 1)
                value = m.transition[left, right] + m.emission[right]
                classes = np.bincount(owner, value, n)
                at, frequent = places(m.symbols.words, w.hashes)
                logs = np.bincount(text[frequent], np.log10(m.counts[at[frequent]] + 1.0), n)
                known = np.bincount(text[frequent], minlength=n)
                # The others, each once for a text.
                h, t = w.hashes[~frequent], text[~frequent]
                order = np.lexsort((h, t))
                h, t = h[order], t[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(h)))
                offsets = pa.array(np.searchsorted(t[first], np.arange(n + 1)), pa.int32())
                arrays = [pa.array(per + 1), pa.array(known.astype(np.int64)), pa.array(logs.astype(float)), pa.array(classes.astype(float))]
                arrays += [pa.ListArray.from_arrays(offsets, pa.array(signed(h[first]))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(w.first, n), *arrays], names=schema.names)

    found = written(df.select(id_col, text_col).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored-texts")
    rare = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # Words whose counts every task holds are not looked up, and no other word is in many rows.
    seen = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    all_rows = found.drop("rare", "times").join(seen, "row", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    base_each = float(np.log10(model.tokens + model.types + 1.0))
    end_log = float(np.log10(end_count + 1.0))
    return all_rows.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0)) + F.lit(1 if end_count else 0)).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs + F.lit(end_log) - F.col("n_tokens") * F.lit(base_each)).alias("base_score"),
        (F.col("classes") + logs + F.lit(end_log)).alias("score"),
    )


def score_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `df`: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows that are not held out and scores all.  Tokens are
    words and one end; base_score is the add-one unigram log10 probability, score the
    class model's.  A null or empty text is its end alone; repeated rows are scored
    (and learnt) each; other columns are not looked at; an empty table gives an
    empty result, and with no training row every token is unknown.
    """
    training = df.where(~held_out(id_col))
    model, counts = train(training, text_col)
    texts = training.count()
    return score(df, model, counts, texts, id_col, text_col).withColumn("held_out", held_out(id_col)).select(id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
