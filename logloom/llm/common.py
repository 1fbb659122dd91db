"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    A cluster names it in `spark.checkpoint.dir`.  Only where that is unset, as in
    local tests, a temporary folder of this machine is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = f"file://{tempfile.mkdtemp(prefix='logloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it again: later jobs start from the
    files, so losing executors costs no more than the tasks they ran."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's vocabulary file, which is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def among_top(df: DataFrame, count: str, most: int, key: str) -> Column:
    """A condition that holds for about the `most` rows with the largest counts, and never for more.

    The counts are looked at by sixteenths of a power of two, some hundred rows whatever the table's size, so unlike a
    sort with a limit this sends next to nothing to the driver.  Of the last step that has some of these rows, those
    are taken whose keys hash lowest.
    """
    step = F.floor(F.log2(count) * 16)
    steps = df.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect()
    total, whole, part, share = 0, None, None, 0.0
    for r in steps:
        if total + r["rows"] > most:
            part, share = r["step"], 0.98 * (most - total) / r["rows"]
            break
        total += r["rows"]
        whole = r["step"]
    above = F.lit(False) if whole is None else step >= whole
    if part is None:
        return above
    return above | ((step == part) & (F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))))
