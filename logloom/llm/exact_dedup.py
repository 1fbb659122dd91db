"""Exact deduplication by skew-safe combining.

Texts are equal when they are identical after removing every `[\\x20\\x09-\\x0D]`.
Copies are combined three times, and at each stage rows meet only if their whole
contents are equal, not just their digests:

1. within each task, before anything is shuffled (partial aggregation);
2. by digest and a salt taken from the row's id, so that a group with a third of
   all rows is dealt to many tasks;
3. the winners of the salts by digest.

Afterwards every row looks up its group by digest.  Should two contents share a
digest, the rows of that digest look up their group by content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SALTS = 16


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest=lambda content: F.sha2(content, 256)) -> DataFrame:
    """One row per row of `df`: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points in its original text stays,
    then the one with the smallest id (a null id counts as smallest).  A null text
    is an empty one.  A repeated row, the same id and an equal text again, counts
    in group_size and has the same keep_id and kept as the first; use
    `drop_copies` to get each such row once.  An empty table gives an empty result.
    Other columns of `df` are not looked at.
    """
    rows = df.select(F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_n"), normalised(F.col(text_col)).alias("_content"))
    rows = rows.withColumn("_digest", digest(F.col("_content")))
    best = F.min(F.struct((-F.col("_n")).alias("order"), F.col("_id").alias("id")))
    salted = rows.groupBy("_digest", F.pmod(F.xxhash64("_id"), F.lit(salts)).alias("_salt"), "_content").agg(best.alias("_best"), F.count("*").alias("_size"))
    groups = (
        salted.repartition("_digest")
        .groupBy("_digest", "_content")
        .agg(F.min("_best").alias("_best"), F.sum("_size").alias("group_size"))
        .withColumn("_contents", F.count("*").over(Window.partitionBy("_digest")))
        .select("_digest", F.when(F.col("_contents") > 1, F.col("_content")).alias("_content"), F.col("_best.id").alias("keep_id"), "group_size")
    )
    groups = written(groups, "exact-groups")
    alone = groups.where("_content is null").drop("_content")
    found = rows.drop("_content", "_n").join(alone, "_digest")
    shared = groups.where("_content is not null")
    if not shared.isEmpty():
        found = found.unionByName(rows.drop("_n").join(shared, ["_digest", "_content"]).drop("_content"))
    return found.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_digest").alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that `exact_groups` keeps, each once, with all their columns."""
    # The id's hash stands for the id, null or not, so that the join and the removal of repeated rows share a shuffle.
    keep = exact_groups(df, id_col, text_col).where("kept").select(F.col("keep_id").alias("_keep"), F.xxhash64("keep_id").alias("_key"), F.col("text_sha256").alias("_digest"))
    keep = keep.distinct().alias("k")
    rows = df.select(F.struct("*").alias("_row"), F.xxhash64(id_col).alias("_key"), F.sha2(normalised(F.col(text_col)), 256).alias("_digest"), F.col(id_col).alias("_id")).alias("r")
    same = (F.col("r._key") == F.col("k._key")) & (F.col("r._digest") == F.col("k._digest")) & F.col("r._id").eqNullSafe(F.col("k._keep"))
    return rows.join(keep, same, "left_semi").dropDuplicates(["_key", "_digest", "_id"]).select("_row.*")
