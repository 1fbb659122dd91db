"""Where tables between two steps go: under the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_folder(spark: SparkSession, name: str, suffix: str = "") -> str:
    """A folder that isn't there yet, under the one that all machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="logloom-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}{suffix}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written once and read again, so that later steps don't compute it anew."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
