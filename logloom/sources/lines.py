"""Physical lines of files, numbered from 1.

Spark splits large files.  A first pass counts the lines of each split and looks at the bytes that a file begins with: a small
table, a row for each split.  The second pass gives each line its number: the lines of the splits before it, and its place in its own,
which follows from the order in which a task reads its rows.  No line is shuffled for that.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import LogProcessingError
from ..functions.texts import trim
from .scratch import kept

#: Lines of one file whose entries are found together; longer files are carried over from block to block.
BLOCK_LINES = 100_000
#: Rows of the table of splits that are sent to every task; beyond that Spark chooses the join.
BROADCAST_SPLITS = 200_000
#: Byte order marks that a file can begin with, but for that of UTF-8, which Spark's reader drops.
MARKS = {"UTF-16BE": b"\xfe\xff", "UTF-16LE": b"\xff\xfe"}


def _scan(spark: SparkSession, paths: str | list[str], charset: str) -> DataFrame:
    """(file_name, _start, _size, _order, _data): lines as they are in the files, in bytes."""
    reader = spark.read if charset == "UTF-8" else spark.read.option("encoding", charset).option("lineSep", "\n")
    about = [F.col("_metadata.file_path").alias("file_name"), F.col("_metadata.file_block_start").alias("_start"), F.col("_metadata.file_size").alias("_size")]
    return reader.text(paths).select(*about, F.monotonically_increasing_id().alias("_order"), F.col("value").alias("_data"))


def _decoded(data: Column, charset: str) -> Column:
    """A line's text; of UTF-16 without the byte order mark and the carriage return."""
    if charset == "UTF-8":
        return data
    raw = data.cast("binary")
    even = F.length(raw) - F.length(raw) % 2
    text = F.concat(F.decode(F.substring(raw, F.lit(1), even), charset), F.when(F.length(raw) % 2 == 1, "\ufffd").otherwise(""))
    return F.regexp_replace(text, "^\ufeff|\r$", "")


def _splits(raw: DataFrame, charset: str) -> DataFrame:
    """(file_name, charset, start, first, lines, blank, bytes, mark, torn): a row for each split that has lines."""
    raw_bytes = F.col("_data").cast("binary")
    begins = F.substring(raw_bytes, 1, 2)
    mark = F.when(begins == F.lit(MARKS["UTF-16BE"]), 1).when(begins == F.lit(MARKS["UTF-16LE"]), 2).otherwise(0)
    counts = raw.groupBy("file_name", F.col("_start").alias("start")).agg(
        F.min("_order").alias("first"),
        F.count("*").alias("lines"),
        F.count_if(trim(_decoded(F.col("_data"), charset)) == "").alias("blank"),
        F.max("_size").alias("bytes"),
        F.first(mark).alias("mark"),  # a split is read by one task, in order
        F.count_if(F.length(raw_bytes) % 2 == 1).alias("torn"),
    )
    return counts.withColumn("charset", F.lit(charset))


class FileScan:
    """The files at a path, counted once; `lines` reads them numbered.

    Their charset is that of their byte order mark, UTF-8 without one, unless `charset` names it.  Lines before `start_line`
    keep their numbers but are left out.  A file whose bytes change between the two passes stops the second one.  In UTF-16
    a line ends with a line feed, and files in which the bytes of one stand across two characters are refused.

    With `rotated` the files of a folder are one log that goes on from file to file, in the order of their names: its lines are
    numbered through, and `file_name` is the folder with `/*`.
    """

    def __init__(self, spark: SparkSession, path: str | list[str], start_line: int = 1, charset: str | None = None, rotated: bool = False):
        self.spark, self.start_line = spark, start_line
        self.log = F.regexp_replace("file_name", "[^/]+$", "*") if rotated else F.col("file_name")
        self.paths = {charset or "UTF-8": path}
        splits = kept(_splits(_scan(spark, path, charset or "UTF-8"), charset or "UTF-8"), "splits")
        if charset is None:
            marked = {m: [unquote(r["file_name"]) for r in splits.where((F.col("start") == 0) & (F.col("mark") == k + 1)).select("file_name").collect()] for k, m in enumerate(MARKS)}
            marked = {m: files for m, files in marked.items() if files}
            if marked:
                self.paths |= marked
                apart = [r["file_name"] for r in splits.where("start = 0 and mark > 0").select("file_name").collect()]
                for m, files in marked.items():
                    again = _splits(_scan(spark, files, m), m)
                    splits = splits.where(~F.col("file_name").isin(apart) | (F.col("charset") != "UTF-8")).unionByName(again)
                splits = kept(splits, "splits")
        self.splits = splits
        if set(self.paths) - {"UTF-8"}:
            self._refuse_torn()
        sums = self.splits.agg(F.count("*").alias("splits"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("blank"), F.lit(0)).alias("blank")).first()
        self.split_count, self.line_count, self.blank_count = sums["splits"], sums["lines"], sums["blank"]
        files = self.splits.groupBy("file_name").agg(F.max("bytes").alias("bytes"), F.sum("lines").alias("lines"))
        files = files.groupBy(self.log).agg(F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"))
        self.byte_count, self.longest_file = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("lines"), F.lit(0))).first()

    def _refuse_torn(self) -> None:
        last = Window.partitionBy("file_name").orderBy(F.desc("start"))
        odd = self.splits.where("charset <> 'UTF-8'").withColumn("n", F.row_number().over(last)).where((F.col("torn") > 1) | (F.col("torn") > 0) & (F.col("n") > 1)).first()
        if odd:
            raise LogProcessingError(f"{odd['file_name']}: the bytes of a line feed stand across two characters of {odd['charset']}")

    def lines(self) -> DataFrame:
        """(file_name, line_number, line)."""
        before = Window.partitionBy(self.log).orderBy("file_name", "start").rowsBetween(Window.unboundedPreceding, -1)
        bases = self.splits.select("file_name", F.col("start").alias("_start"), "charset", self.log.alias("_log"), (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first") + 1).alias("_base"))
        out = None
        for charset, paths in self.paths.items():
            own = bases.where(F.col("charset") == charset).drop("charset")
            raw = _scan(self.spark, paths, charset)
            if charset == "UTF-8" and len(self.paths) > 1:  # the files with other marks come from scans of their own
                raw = raw.join(F.broadcast(own.select("file_name").distinct()), "file_name", "left_semi")
            rows = raw.join(F.broadcast(own) if self.split_count <= BROADCAST_SPLITS else own, ["file_name", "_start"], "left")
            base = F.coalesce("_base", F.raise_error(F.concat(F.lit("a file changed while it was read: "), "file_name")).cast("long"))
            lines = rows.select(F.col("_log").alias("file_name"), (base + F.col("_order")).alias("line_number"), _decoded(F.col("_data"), charset).alias("line"))
            out = lines if out is None else out.unionByName(lines)
        return out.where(F.col("line_number") >= self.start_line) if self.start_line > 1 else out


def read_lines(spark: SparkSession, path: str | list[str], start_line: int = 1, charset: str | None = None) -> DataFrame:
    """(file_name, line_number, line) of text files of any size."""
    return FileScan(spark, path, start_line, charset).lines()


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, bytes) without reading the files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_name"), F.col("length").alias("bytes"))
