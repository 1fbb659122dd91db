"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and the first letters of its longer words,
hashed to a fixed number of buckets.  The machine learns a weight and a factor vector
for each bucket it has, so that pairs of terms, such as an insult with the mention of
a group, count beyond the sum of their weights.  It has the buckets that tell the
labels apart by a chi-square test over the training rows, and those that do so in a
pair with another, which is tested for all pairs of the most frequent buckets.  (With
all buckets it learns rows by heart: held-out toxic texts are missed four times as often.)

The training rows are about `most_rows` labelled rows, those whose ids hash lowest;
that bound is what makes the model's inputs fit anywhere.  They stay in Spark: shards
of them learn on their own for some epochs, then their changes are averaged, and so
on.  Scoring runs over every whole text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .words import NOT_ALNUM, Words, mix, word_chunks

BUCKETS = 1 << 22
#: Bytes of a word that make a prefix term.
PREFIXES = (4, 5)
MOST_ROWS = 60_000
MOST_TERMS = 4096
#: The buckets that most training rows have: so many are looked at in pairs.
FREQUENT_TERMS = 512
FACTORS = 4
#: Training rows that learn together, and how many times shards come together.
SHARD_ROWS = 10_000
ROUNDS = 3
#: Every row is learnt from so many times, and few rows more often, until as many were learnt from as this.
EPOCHS = 12
LEAST_LEARNT = 150_000


class Model(NamedTuple):
    buckets: np.ndarray  # sorted
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n rows that have `terms` (numbers into `buckets`) in `rows`."""
        linear = self.bias + np.bincount(rows, self.weights[terms], n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[terms, f]
            pairs += np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n)
        return 1 / (1 + np.exp(-np.clip(linear + pairs / 2, -40, 40)))


def hashed_terms(words: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text number within the chunk, bucket) of each text's distinct terms."""
    size = words.ends - words.starts
    text = np.repeat(np.arange(words.last - words.first), np.diff(words.bounds))
    found, owners = [words.hashes], [text]
    for n in PREFIXES:
        longer = size > n
        letters = words.data[words.starts[longer][:, None] + np.arange(n)].astype(np.uint64)
        value = np.zeros(len(letters), np.uint64)
        for k in range(n):
            value = value << np.uint64(8) | letters[:, k]
        found.append(mix(value + np.uint64(n << 56)))
        owners.append(text[longer])
    key = np.concatenate(owners).astype(np.uint64) << np.uint64(32) | (np.concatenate(found) % np.uint64(buckets))
    key = np.unique(key)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def row_terms(df: DataFrame, text_col: str, keep: list[str], only: np.ndarray | None = None) -> DataFrame:
    """`keep` and terms: each row's buckets; with `only`, numbers into that sorted array instead."""
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("terms", T.ArrayType(T.IntegerType()))])
    shared = df.sparkSession.sparkContext.broadcast(only)

    def run(batches):
        chosen = shared.value
        for b in batches:
            for words in word_chunks(b.column(len(keep)), blank=NOT_ALNUM):
                text, bucket = hashed_terms(words)
                if chosen is not None:
                    text, bucket = chosen_terms(chosen, text, bucket)
                n = words.last - words.first
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)), pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(words.first, n) for k in range(len(keep))), lists], names=schema.names)

    return df.select(*keep, text_col).mapInArrow(run, schema)


def chosen_terms(chosen: np.ndarray, text: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(chosen):
        return text[:0], bucket[:0]
    at = np.minimum(np.searchsorted(chosen, bucket), len(chosen) - 1)
    hit = chosen[at] == bucket
    return text[hit], at[hit]


class State(NamedTuple):
    """What is learnt, and the sums of squared gradients (g...) by which AdaGrad sizes its steps."""

    bias: np.ndarray
    gb: np.ndarray
    w: np.ndarray
    gw: np.ndarray
    v: np.ndarray
    gv: np.ndarray

    def model(self, buckets: np.ndarray) -> Model:
        return Model(buckets, float(self.bias[0]), self.w, self.v)


def first_state(m: int, seed: int = 7) -> State:
    return State(np.zeros(1), np.full(1, 1e-6), np.zeros(m), np.full(m, 1e-6), np.random.default_rng(seed).normal(0, 0.05, (m, FACTORS)), np.full((m, FACTORS), 1e-6))


def learn(terms: list[np.ndarray], labels: np.ndarray, costs: tuple[float, float], state: State, epochs: int, seed: int, batch: int = 256, rate: float = 0.1, decay: float = 1e-4) -> State:
    """AdaGrad on the logistic loss; `costs` are those of the labels 0 and 1."""
    rng, n = np.random.default_rng(seed), len(labels)
    bias, gb, w, gw, v, gv = (x.copy() for x in state)
    cost = np.where(labels == 1, costs[1], costs[0])
    for _ in range(epochs):
        order = rng.permutation(n)
        for first in range(0, n, batch):
            part = order[first : first + batch]
            rows = np.repeat(np.arange(len(part)), [len(terms[i]) for i in part])
            x = np.concatenate([terms[i] for i in part]) if len(rows) else np.zeros(0, np.int64)
            sums = np.stack([np.bincount(rows, v[x, f], len(part)) for f in range(FACTORS)], 1)
            squares = np.stack([np.bincount(rows, v[x, f] ** 2, len(part)) for f in range(FACTORS)], 1)
            value = bias + np.bincount(rows, w[x], len(part)) + (sums**2 - squares).sum(1) / 2
            error = (1 / (1 + np.exp(-np.clip(value, -40, 40))) - labels[part]) * cost[part] / len(part)
            db = error.sum()
            gb += db**2
            bias -= rate * db / np.sqrt(gb)
            used, place = np.unique(x, return_inverse=True)
            dw = np.bincount(place, error[rows], len(used)) + decay * w[used]
            dv = np.stack([np.bincount(place, error[rows] * (sums[rows, f] - v[x, f]), len(used)) for f in range(FACTORS)], 1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return State(bias, gb, w, gw, v, gv)


def together(state: State, shards: list[State]) -> State:
    """`state` with the mean change of the shards that changed each of its numbers."""
    out = []
    for k, old in enumerate(state):
        change = np.stack([s[k] - old for s in shards])
        out.append(old + change.sum(0) / np.maximum(1, (change != 0).sum(0)))
    return State(*out)


def class_costs(n: float, positive: float) -> tuple[float, float]:
    """Each class has half of the weight."""
    return n / (2 * max(1.0, n - positive)), n / (2 * max(1.0, positive))


def epochs_for(n: float) -> int:
    return max(EPOCHS, int(LEAST_LEARNT / max(n, 1.0)))


def fit(terms: list[np.ndarray], labels: np.ndarray, buckets: np.ndarray, epochs: int | None = None, seed: int = 7) -> Model:
    """A model learnt from rows in memory."""
    epochs = epochs or epochs_for(len(labels))
    return learn(terms, labels, class_costs(len(labels), labels.sum()), first_state(len(buckets), seed), epochs, seed).model(buckets)


def fit_shards(rows: DataFrame, buckets: np.ndarray, costs: tuple[float, float], epochs: int, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """A model learnt from `rows` (_label, _shard, terms), whose shards stand together.  Only the shards' states, some
    hundred bytes for each bucket, go to the driver."""
    state, schema = first_state(len(buckets), seed), "state binary"
    for k in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((buckets, state))

        def run(batches, k=k, shared=shared):
            chosen, start = shared.value
            shards: dict[int, tuple[list, list]] = {}
            for b in batches:
                lists = b.column(2)
                text = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False))
                text, term = chosen_terms(chosen, text, lists.flatten().to_numpy(zero_copy_only=False))
                cuts = np.searchsorted(text, np.arange(len(b) + 1)).tolist()
                for i, (label, shard) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    own = shards.setdefault(shard, ([], []))
                    own[0].append(term[cuts[i] : cuts[i + 1]])
                    own[1].append(float(label))
            for shard, (terms, labels) in shards.items():
                new = learn(terms, np.array(labels), costs, start, epochs // rounds, seed + 1000 * k + shard)
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in new]).tobytes()])], names=["state"])

        found = []
        for r in rows.mapInArrow(run, schema).collect():  # a row for each shard
            flat, at = np.frombuffer(r["state"]), np.append(0, np.cumsum([x.size for x in state]))
            found.append(State(*(flat[a:b].reshape(x.shape) for a, b, x in zip(at[:-1], at[1:], state, strict=True))))
        state = together(state, found)
        shared.unpersist()
    return state.model(buckets)


def telling_pairs(rows: DataFrame, buckets: np.ndarray, n: float, positive: float, least: float) -> list[int]:
    """Those of `buckets` that, with another one, tell the labels apart by at least so much chi-square more than the two
    do alone.  Tasks count pairs in a table of the buckets' number squared, whatever the number of rows."""
    m = len(buckets)
    shared = rows.sparkSession.sparkContext.broadcast(buckets)

    def run(batches):
        both, toxic = np.zeros((m, m)), np.zeros((m, m))
        for b in batches:
            lists = b.column(1)
            text = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False))
            has = np.zeros((len(b), m), np.float32)
            has[chosen_terms(shared.value, text, lists.flatten().to_numpy(zero_copy_only=False))] = 1
            marked = has[b.column(0).to_numpy() == 1]
            both += has.T @ has
            toxic += marked.T @ marked
        pair = np.flatnonzero(np.triu(both))
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(both.ravel()[pair]), pa.array(toxic.ravel()[pair])], names=["pair", "both", "toxic"])

    counts = rows.select("_label", "terms").mapInArrow(run, "pair long, both double, toxic double").groupBy("pair").agg(F.sum("both").alias("both"), F.sum("toxic").alias("toxic")).toArrow()
    both, toxic = np.zeros((m, m)), np.zeros((m, m))
    for table, name in ((both, "both"), (toxic, "toxic")):
        table.ravel()[counts["pair"].to_numpy()] = counts[name].to_numpy()
        table += np.triu(table, 1).T
    share = positive / max(n, 1.0)

    def chi2(cells) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return sum(np.where(size > 0, (t - size * share) ** 2 / (size * share * (1 - share)), 0.0) for size, t in cells)

    rows_of, toxic_of = np.diag(both), np.diag(toxic)
    alone = chi2([(rows_of, toxic_of), (n - rows_of, positive - toxic_of)])
    a, b, x, y = rows_of[:, None], rows_of[None], toxic_of[:, None], toxic_of[None]
    more = chi2([(both, toxic), (a - both, x - toxic), (b - both, y - toxic), (n - a - b + both, positive - x - y + toxic)]) - alone[:, None] - alone[None]
    np.fill_diagonal(more, 0)
    return buckets[(more >= least).any(1)].tolist() if 0 < share < 1 and m else []


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = MOST_ROWS, most_terms: int = MOST_TERMS, frequent_terms: int = FREQUENT_TERMS, least_rows: int = 3, least_chi2: float = 15.0, least_pair_chi2: float = 30.0) -> Model:
    """A model from the rows of `df` that `labels` (id, label 0 or 1) marks.  Rows without a label are ignored;
    with none, the model gives every text 0.5 less a little, that is label 0."""
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_label"))
    share = min(1.0, most_rows / max(1, some.count()))
    some = some.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The bound on the labelled rows bounds this broadcast: about `most_rows` rows of 12 bytes.
    marked = df.select(id_col, text_col).join(F.broadcast(some), id_col).withColumn("_hash", F.xxhash64(id_col))
    rows = written(row_terms(marked, text_col, ["_label", "_hash"]), "toxicity-terms")
    size = rows.groupBy().agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    n, p = float(size[0]), float(size[1])
    counts = written(rows.select("_label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count("*").cast("double").alias("rows"), F.sum("_label").cast("double").alias("toxic")), "toxicity-counts")
    counts = counts.where((F.col("rows") >= least_rows) & (F.col("rows") < n))
    # chi-square of the 2 x 2 table of term and label
    off = F.col("toxic") * F.lit(n) - F.col("rows") * F.lit(p)
    chi2 = F.lit(n) * off * off / (F.col("rows") * (F.lit(n) - F.col("rows")) * F.lit(max(p * (n - p), 1.0)))
    telling = counts.withColumn("chi2", chi2).where(F.col("chi2") >= least_chi2).orderBy(F.desc("chi2"), "bucket").limit(most_terms)
    frequent = counts.orderBy(F.desc("rows"), "bucket").limit(frequent_terms)
    in_pairs = telling_pairs(rows, np.array(sorted(r["bucket"] for r in frequent.collect()), np.int64), n, p, least_pair_chi2)
    buckets = np.array(sorted({r["bucket"] for r in telling.collect()} | set(in_pairs)), np.int64)
    if not n or not len(buckets):
        return Model(buckets[:0], -0.1, np.zeros(0), np.zeros((0, FACTORS)))
    shards = max(1, -(-int(n) // SHARD_ROWS))
    chosen = F.array_intersect("terms", F.lit(buckets.tolist()).cast("array<int>"))
    shard = F.pmod(F.col("_hash"), F.lit(shards)).cast("int").alias("_shard")
    dealt = rows.select("_label", shard, F.sort_array(chosen).alias("terms"), "_hash").repartition(shards, "_shard").sortWithinPartitions("_shard", "_hash").drop("_hash")
    return fit_shards(written(dealt, "toxicity-shards"), buckets, class_costs(n, p), epochs_for(n))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, score.  A null or empty text has no terms and gets the model's bias;
    repeated rows get equal scores; other columns are not looked at."""
    schema = T.StructType([df.schema[id_col], T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for words in word_chunks(b.column(1), blank=NOT_ALNUM):
                text, terms = chosen_terms(shared.value.buckets, *hashed_terms(words))
                n = words.last - words.first
                yield pa.RecordBatch.from_arrays([b.column(0).slice(words.first, n), pa.array(shared.value.scores(text, terms, n), pa.float64())], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `df`: id, held_out, score, predicted; learnt only from rows that are not held out."""
    model = train(df, labels.where(~held_out(id_col)), id_col, text_col)
    return score(df, model, id_col, text_col).select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of `df` that score under `threshold`, with all their columns; nothing is shuffled for it."""
    model = train(df, labels.where(~held_out(id_col)), id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            for words in word_chunks(b.column(at), blank=NOT_ALNUM):
                text, terms = chosen_terms(shared.value.buckets, *hashed_terms(words))
                n = words.last - words.first
                yield b.slice(words.first, n).filter(pa.array(shared.value.scores(text, terms, n) < threshold))

    return df.mapInArrow(run, df.schema)
