"""Hard negatives by a pivot table.

Vectors get one more component, sqrt(M - |x|^2) for stored rows (M is the largest squared norm) and 0 for anchors.
Then |a' - x'|^2 = |a|^2 + M - 2 a.x: the inner product falls as the Euclidean distance grows.  The pivot table stores each
row's distances to a few pivots.  By the triangle inequality the differences and the sums of an anchor's and a row's
distances bracket their distance, and so the score.  Rows whose bracket misses what is looked for are left out;
the scores of the survivors are computed exactly, in integers.

Anchors meet all rows in blocks: blocks of bounded size of anchors, each sent to every group of rows.  A task reads
its anchors, then streams its rows past them and keeps the best few of each anchor, whose scores tighten the bracket
that the next rows have to reach.  Nothing is gathered on the driver but the sample from which the pivots are chosen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PIVOTS = 16
#: Pivots are chosen among so many rows, those whose ids hash lowest.
SAMPLE_ROWS = 2000
#: Bytes of the vectors of a block of anchors, and its anchors at most.
ANCHOR_BYTES, ANCHOR_ROWS = 1 << 22, 8192
#: Rows of a group at most, and at least if there are fewer groups than tasks.
GROUP_ROWS, LEAST_GROUP = 1 << 17, 2048
#: Squared norms stay below this: every inner product then fits a long.
NORM_LIMIT = 2.0**62

INDEX = "row long, id long, label long, anchor boolean, vector array<long>, pivots array<double>"
FOUND = "anchor_row long, anchor_id long, window int, id long, score long"


class Pivots(NamedTuple):
    """Augmented pivots, and the largest squared norm of all rows."""

    points: np.ndarray
    largest: float

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Of vectors to the pivots: (pivots, vectors).  As rows all vectors get the norm `largest`, as queries they keep theirs."""
        norms = np.einsum("ij,ij->i", x, x)
        square = self.largest + (norms if query else self.largest) - 2 * (self.points[:, :-1] @ x.T)
        if not query:
            square -= 2 * self.points[:, -1:] * np.sqrt(np.maximum(self.largest - norms, 0))
        return np.sqrt(np.maximum(square, 0))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width` numbers; shorter vectors are filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def choose_pivots(sample: np.ndarray, largest: float, count: int) -> Pivots:
    """Rows of the sample far from each other: each is the one farthest from those before."""
    norms = np.einsum("ij,ij->i", sample, sample)
    points = np.c_[sample, np.sqrt(np.maximum(largest - norms, 0))]
    chosen, far = [], np.full(len(points), np.inf)
    while len(chosen) < min(count, len(points)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return Pivots(points[chosen], largest)


def usable(df: DataFrame, anchors: Column, label: Column, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, label, anchor, vector, norm): the rows that take part, their components scaled to integers."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return rows.withColumn("norm", norm).where(F.col("norm") < NORM_LIMIT)


class Block:
    """Anchors that a task holds, and the best rows found for each of their windows so far."""

    def __init__(self, batch: pa.RecordBatch, width: int, pivots: Pivots, same: bool, keep: int):
        self.rows, self.ids, self.labels = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("row", "id", "label"))
        self.vectors = matrix(batch.column("vector"), width)
        self.floats = self.vectors.astype(float)
        self.norms = np.einsum("ij,ij->i", self.floats, self.floats)
        self.distances = pivots.distances(self.floats, query=True).T
        self.lows, self.highs = batch.column("lows").to_pylist(), batch.column("highs").to_pylist()
        self.best = [[(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(w) for w in self.lows]
        #: The least score that still counts, by anchor and window: that of the window's lower end or of its last row once it is full.
        self.least = [list(w) for w in self.lows]
        self.pivots, self.same, self.keep = pivots, same, keep

    def meet(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, near: np.ndarray) -> int:
        """Look for each anchor's rows; how many scores had to be computed.  near: distances to the pivots, (pivots, rows)."""
        floats = vectors.astype(float)
        norms = np.einsum("ij,ij->i", floats, floats)
        computed = 0
        for i, own in enumerate(self.distances):
            if not self.least[i]:
                continue
            base = self.norms[i] + self.pivots.largest
            slack = 1 + 1e-9 * base
            lower = np.abs(near - own[:, None]).max(axis=0)
            fits = (labels == self.labels[i]) == self.same
            fits &= base - lower * lower + slack >= 2 * min(self.least[i])
            highest = max(self.highs[i])
            if 2 * highest < base:
                upper = (near + own[:, None]).min(axis=0)
                fits &= base - upper * upper - slack <= 2 * highest
            if self.same:
                fits &= rows != self.rows[i]
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            computed += len(at)
            if self.norms[i] * norms[at].max() < 2.0**104:
                scores = (floats[at] @ self.floats[i]).astype(np.int64)  # no sum of products reaches 2^53
            else:
                scores = (vectors[at] * self.vectors[i]).sum(axis=1)
            good = (scores >= min(self.least[i])) & (scores <= highest)
            if good.any():
                self.take(i, scores[good], ids[at[good]])
        return computed

    def take(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, -scores))
        scores, ids = scores[order], ids[order]
        for w, high in enumerate(self.highs[i]):
            first = int(np.searchsorted(-scores, -high))
            had = self.best[i][w]
            s, j = np.r_[had[0], scores[first : first + self.keep]], np.r_[had[1], ids[first : first + self.keep]]
            order = np.lexsort((j, -s))[: self.keep]
            order = order[s[order] >= self.lows[i][w]]
            self.best[i][w] = s[order], j[order]
            if len(order) == self.keep:
                self.least[i][w] = int(s[order[-1]])

    def found(self) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(self.rows), 512):
            rows = [(int(self.rows[i]), int(self.ids[i]), w, int(j), int(s)) for i in range(first, min(first + 512, len(self.rows))) for w, (ss, js) in enumerate(self.best[i]) for s, j in zip(ss, js, strict=True)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["anchor_row", "anchor_id", "window", "id", "score"])


def best_in_windows(index: DataFrame, anchors: DataFrame, pivots: Pivots, width: int, rows: int, same: bool, keep: int) -> DataFrame:
    """`FOUND`: for each anchor and window the `keep` best rows of the same label, or of others.

    anchors: row, id, label, vector, lows, highs; window w of an anchor holds the scores from lows[w] to highs[w].
    """
    spark = index.sparkSession
    count = anchors.count()
    blocks = max(1, -(-count // max(16, min(ANCHOR_ROWS, ANCHOR_BYTES // (8 * max(width, 1))))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-rows // GROUP_ROWS), min(-(-2 * tasks // blocks), rows // LEAST_GROUP))
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part_of = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    asked = anchors.select(part_of(blocks).alias("block"), parts(groups).alias("group"), F.lit(0).alias("kind"), "row", "id", "label", "vector", F.lit(None).cast("array<double>").alias("pivots"), "lows", "highs")
    there = index.select(parts(blocks).alias("block"), part_of(groups).alias("group"), F.lit(1).alias("kind"), "row", "id", "label", "vector", "pivots", F.lit(None).cast("array<long>").alias("lows"), F.lit(None).cast("array<long>").alias("highs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, block = None, [], None
        for b in batches:
            codes = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in ("block", "group", "kind")])
            cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                if first == last:
                    continue
                part, now, kind = b.slice(first, last - first), tuple(codes[:2, first].tolist()), int(codes[2, first])
                if now != key:
                    if block is not None:
                        yield from block.found()
                    key, waiting, block = now, [], None
                if kind == 0:  # a block's anchors may reach over several batches
                    waiting.append(part)
                    continue
                if waiting:
                    table = pa.Table.from_batches(waiting).combine_chunks()
                    block, waiting = Block(table.to_batches()[0], width, pivots, same, keep), []
                if block is not None:
                    near = np.ascontiguousarray(matrix(part.column("pivots"), len(pivots.points)).T)
                    block.meet(*(part.column(n).to_numpy(zero_copy_only=False) for n in ("row", "id", "label")), matrix(part.column("vector"), width), near)
        if block is not None:
            yield from block.found()

    return asked.unionByName(there).repartition("block", "group").sortWithinPartitions("block", "group", "kind").mapInArrow(run, FOUND)


def hard_negatives(
    df: DataFrame,
    anchors: Column,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    pivot_count: int = PIVOTS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are scaled and floored; a score is the integer inner product with the anchor, higher ones come first,
    then smaller ids.  An anchor (a row for which `anchors` holds) has the first `positives` other rows of its label.
    For each of them the first `negatives` rows of other labels are returned whose score is `percent` to 100 in 100
    of the positive's; none for a negative score.

    Rows with a null id, label or vector or with a null or non-finite component take no part, nor do rows whose squared
    norm is 2^62 or more, as their scores don't fit a long.  Vectors of unlike lengths meet as if the shorter had zeros
    at its end; an empty vector has score 0 with all.  Rows are told apart by their place, not by their id: a repeated row
    is another row, and an anchor that is there twice has its results twice.  An empty table, or one without anchors,
    gives an empty result.  Other columns of `df` are not looked at.
    """
    rows = usable(df, anchors, F.col("label") if label is None else label, id_col, vector_col, scale)
    measures = rows.agg(F.count("*").alias("n"), F.max("norm").alias("largest"), F.max(F.size("vector")).alias("width")).first()
    width, largest = max(measures["width"] or 0, 1), float(measures["largest"] or 0)
    sample = rows.orderBy(F.xxhash64("id")).limit(sample_rows).select("vector").toArrow().column("vector").combine_chunks()
    pivots = choose_pivots(matrix(sample, width).astype(float), largest, pivot_count)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = pivots.distances(matrix(b.column("vector"), width).astype(float), query=False).T
            lists = pa.ListArray.from_arrays(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1], near.ravel())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("row", "id", "label", "anchor", "vector")), lists], names=["row", "id", "label", "anchor", "vector", "pivots"])

    index = written(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", "vector").mapInArrow(measured, INDEX), "pivot-table")
    asked = index.where("anchor").select("row", "id", "label", "vector")
    least, most = -(1 << 63), (1 << 63) - 1
    everything = asked.withColumns({"lows": F.array(F.lit(least)), "highs": F.array(F.lit(most))})
    near = best_in_windows(index, everything, pivots, width, measures["n"], True, positives)
    place = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.desc("score"), "id"))
    near = near.withColumn("place", place).where(F.col("place") <= positives)
    # 5 percent * score <= 100 * negative score: the least such integer, without leaving the range of a long
    low = F.when(F.col("score") >= 0, -F.floor(-F.col("score").cast("decimal(25,0)") * percent / 100)).cast("long")
    near = written(near.where("score >= 0").select("anchor_row", "place", F.col("id").alias("positive_id"), "score", low.alias("low")), "positives")

    windows = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "low", "score", "positive_id"))).alias("w"))
    narrowed = asked.join(windows, asked["row"] == windows["anchor_row"]).select("row", "id", "label", "vector", F.col("w.low").alias("lows"), F.col("w.score").alias("highs"))
    found = best_in_windows(index, narrowed, pivots, width, measures["n"], False, negatives)
    rank = F.row_number().over(Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives).alias("n")
    ranked = near.withColumn("window", F.row_number().over(Window.partitionBy("anchor_row").orderBy("place")) - 1).alias("p")
    return found.join(ranked, ["anchor_row", "window"]).select(F.col("n.anchor_id"), F.col("p.positive_id"), F.col("n.rank"), F.col("n.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"))


#: The query's rows in SQL: all pairs of an anchor and a row.
HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
