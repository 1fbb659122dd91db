"""Top values without shuffling every different value.

Each task keeps a frequent-items sketch of bounded size, and the sketches are merged: that gives candidates, and a bound
on how often a value can occur that isn't one.  A second pass counts the candidates exactly.  If the last of the top
values is above the bound no other value can belong to them; else the fields concerned are counted in full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import keyword_field
from .aggregates import TOP

#: Values that a sketch tracks, and candidates of a field that are counted again.
TRACKED, CANDIDATES = 10_000, 1_000


def heavy_values(entries: DataFrame, fields: tuple[str, ...], limit: int = TOP, tracked: int = TRACKED, candidates: int = CANDIDATES, columns: dict[str, str] | None = None) -> DataFrame:
    """(field, value, count): the exact top values of keyword fields (or of `columns`, a column by name), most frequent first, then by
    value.  Two scans; what they shuffle is bounded by `tracked` but for fields whose values are about equally frequent."""
    names = columns or {f: keyword_field(f) for f in fields}
    candidates = max(candidates, limit + 1)
    sketches = entries.agg(*[F.expr(f"approx_top_k(`{c}`, {candidates}, {max(tracked, candidates)})").alias(f"s{i}") for i, c in enumerate(names.values())], *[F.count(c).alias(f"n{i}") for i, c in enumerate(names.values())]).first()
    # A sketch of m slots is off by at most 3.5 n / m, and reports values whose count surely exceeds that; m is at least 4/3 of those tracked.
    bounds, found = {}, []
    for i, f in enumerate(names):
        items = [(r["item"], r["count"]) for r in sketches[f"s{i}"] if r["item"] is not None]
        bounds[f] = 2 * 3.5 * sketches[f"n{i}"] / (4 / 3 * max(tracked, candidates)) if sketches[f"n{i}"] > tracked else 0.0
        if len(items) + 1 >= candidates:  # others that it tracks may not have been told
            bounds[f] = max(bounds[f], min(c for _, c in items))
        found += [(f, v) for v, _ in items]
    spark = entries.sparkSession
    chosen = F.broadcast(spark.createDataFrame(found, "field string, value string"))  # at most `candidates` a field
    exact = pairs_of(entries, names).join(chosen, ["field", "value"], "left_semi").groupBy("field", "value").agg(F.count("*").alias("count"))
    top = ranked(exact, limit)
    rows = top.collect()  # `limit` rows a field
    sure, open_fields = [], {}
    for f in names:
        own = sorted([r for r in rows if r["field"] == f], key=lambda r: -r["count"])
        # all different values are known if no sketch had to forget any
        if bounds[f] == 0 or len(own) == limit and own[-1]["count"] > bounds[f]:
            sure += [(r["field"], r["value"], r["count"]) for r in own]
        else:
            open_fields[f] = names[f]
    out = spark.createDataFrame(sure, "field string, value string, count long")
    if open_fields:
        out = out.unionByName(ranked(pairs_of(entries, open_fields).groupBy("field", "value").agg(F.count("*").alias("count")), limit))
    return out


def pairs_of(entries: DataFrame, names: dict[str, str]) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in names.items()])).alias("p")
    return entries.select(pairs).where("p.value is not null").select("p.field", "p.value")


def ranked(counts: DataFrame, limit: int, parts: int = 64) -> DataFrame:
    """The `limit` largest counts of each field; hashed parts of a field are ranked first, so no field goes through one task."""
    part = Window.partitionBy("field", F.pmod(F.xxhash64("value"), F.lit(parts))).orderBy(F.desc("count"), "value")
    leading = counts.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= limit).drop("_rank")
    whole = Window.partitionBy("field").orderBy(F.desc("count"), "value")
    return leading.withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= limit).drop("_rank")
