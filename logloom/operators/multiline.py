"""Stack traces over many lines.

Lines are classed: blank (B), stack line (S), exception line (E), a grammar's line whose message tells of an
exception (I) or not (M), any other (U).  An E or I line stays open until the next B, E, I or M, and takes the S and U
lines in between; other S and U lines stand alone.  So what a line belongs to follows from the last of B, E, I, M
before it.  That is found within blocks of lines, and carried over from block to block by a table with a row for
each block, so no file need pass through one task.

An entry's trace comes in parts of a bounded number of lines.  The entry has the first; those after it are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.lines import BLOCK_LINES

#: Boundary classes by the number that stands for them.
BOUNDARIES = ("B", "E", "I", "M")
#: Lines of a part of a trace.
PART_LINES = 1024


def dealt(lines: DataFrame, about_lines: int | None, *keys: str) -> DataFrame:
    """`lines` by their keys: if they are known to be many, in two parts for each block, so that a task's share doesn't grow with
    their number; else in the session's parts."""
    parts = -(-2 * (about_lines or 0) // BLOCK_LINES)
    many = parts > 2 * lines.sparkSession.sparkContext.defaultParallelism
    return lines.repartition(parts, *keys) if many else lines.repartition(*keys)


def assign_heads(lines: DataFrame, about_lines: int | None = None) -> DataFrame:
    """`lines` (file_name, line_number, class, ...) with head_line, the line of the entry that each belongs to, and
    `_at`, the block by which they are dealt out.

    The lines are dealt out by block once, and both the blocks' last boundaries and the lines' own follow from that
    exchange.  It is the same for both, and so made once, only if both need the same columns, hence `_all`, and the same
    rows, hence a block that is never null.  File and block are one key, which all steps share even where all lines are of one file.
    A boundary is one number, its line and its class, so the last is the largest.
    """
    block = F.coalesce(F.floor(F.col("line_number") / BLOCK_LINES), F.lit(-1))
    lines = dealt(lines.withColumn("_at", F.struct("file_name", block.alias("block"))), about_lines, "_at")
    code = F.lit(None).cast("long")
    for i, c in enumerate(BOUNDARIES):
        code = F.when(F.col("class") == c, F.col("line_number") * 4 + i).otherwise(code)
    inside = Window.partitionBy("_at").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("_at.file_name").orderBy("_at.block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("_at").agg(F.max(code).alias("_last"), F.max(F.xxhash64(*lines.columns)).alias("_all"))
    blocks = blocks.select("_at", F.max(F.when(F.col("_all").isNotNull(), F.col("_last"))).over(ahead).alias("_carried"))
    lines = lines.withColumn("_own", F.max(code).over(inside)).join(blocks, "_at")
    last = F.greatest("_own", "_carried")
    open_before = F.coalesce((last % 4).isin(BOUNDARIES.index("E"), BOUNDARIES.index("I")), F.lit(False))
    continues = F.col("class").isin("S", "U") & open_before
    return lines.withColumn("head_line", F.when(continues, F.floor(last / 4)).otherwise(F.col("line_number"))).drop("_own", "_carried")


def part_number(part_lines: int) -> Column:
    """The part that a line belongs to: an entry's lines follow each other without gaps."""
    return F.floor((F.col("line_number") - F.col("head_line")) / part_lines)


def attach_traces(lines: DataFrame, blank: bool = False, part_lines: int = PART_LINES, about_lines: int | None = None) -> DataFrame:
    """The head lines of `assign_heads`, with stack_trace, lines (how many the entry has) and parts (of its trace); blank lines
    only if `blank` asks for them.

    An entry's lines of one block are brought together where they are, so a trace of any length is shuffled as a row for each block.
    It takes the text of the first part only; lines of later parts count.
    """
    names = [c for c in lines.columns if c not in ("file_name", "head_line", "_at")]
    is_head = F.col("head_line") == F.col("line_number")
    part = part_number(part_lines)
    lines = (lines if blank else lines.where(F.col("class") != "B")).withColumn("_entry", F.struct("file_name", "head_line"))
    inside = lines.groupBy("_at", "_entry").agg(
        F.first(F.when(is_head, F.struct(*names)), ignorenulls=True).alias("_head"),
        F.collect_list(F.when(~is_head & (part == 0), F.struct("line_number", "line"))).alias("_more"),
        F.count("*").alias("lines"),
        F.max(part).alias("part"),
    )
    grouped = dealt(inside.drop("_at"), about_lines, "_entry").groupBy("_entry").agg(
        F.first("_head", ignorenulls=True).alias("_head"),
        F.flatten(F.collect_list("_more")).alias("_more"),
        F.sum("lines").alias("lines"),
        (F.max("part") + 1).alias("parts"),
    )
    heads = grouped.select("_entry.file_name", "_head.*", F.array_join(F.transform(F.array_sort("_more"), lambda x: x["line"]), "\n").alias("_rest"), (F.size("_more") > 0).alias("_goes_on"), "lines", "parts")
    first = F.when(F.col("class").isin("E", "S"), F.col("line"))
    return heads.withColumn("stack_trace", F.concat_ws("\n", first, F.when(F.col("_goes_on"), F.col("_rest")))).withColumn("stack_trace", F.when(first.isNotNull() | F.col("_goes_on"), F.col("stack_trace"))).drop("_rest", "_goes_on")


def trace_parts(lines: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """(file_name, head_line, part, text): what `attach_traces` leaves out, parts from 1, in rows of bounded length.  The whole trace is
    the entry's and these, in order, with line feeds between."""
    part = part_number(part_lines)
    rows = lines.where((F.col("class") != "B") & (part > 0)).groupBy("file_name", "head_line", part.alias("part")).agg(F.collect_list(F.struct("line_number", "line")).alias("more"))
    return rows.select("file_name", "head_line", "part", F.array_join(F.transform(F.array_sort("more"), lambda x: x["line"]), "\n").alias("text"))
