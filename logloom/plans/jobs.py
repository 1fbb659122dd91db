"""Job records: an append-only table, of whose rows the latest for a job counts."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..errors import JobNotFoundError

QUEUED, PROCESSING, COMPLETED, FAILED = "QUEUED", "PROCESSING", "COMPLETED", "FAILED"
SCHEMA = """job_id string, status string, progress int, message string, error string, file_name string, file_size long, timestamp_format string,
  started_at timestamp, updated_at timestamp, completed_at timestamp, total_lines long, processed_lines long, successful_lines long, failed_lines long,
  processing_time_ms long, lines_per_second double, deleted boolean, skipped_lines long, continuation_lines long, success_rate double, start_line long, end_line long,
  bytes_read long, bytes_per_second double, total_entries long, saved_entries long, failed_entries long, batches long, average_save_ms double, error_count long,
  inferred_timestamps long, split_traces long, level_counts map<string,long>"""


def progress(done: int, total: int) -> int:
    """Percent: 5 at the start, 95 when all lines are read."""
    return 5 + done * 90 // total if total else 5


def per_second(number: int, ms: int) -> float:
    return number * 1000 / ms if ms > 0 else 0.0


@dataclass(frozen=True)
class Job:
    job_id: str
    status: str = QUEUED
    progress: int = 0
    message: str | None = None
    error: str | None = None
    file_name: str | None = None
    file_size: int | None = None
    timestamp_format: str | None = None
    started_at: datetime | None = None
    updated_at: datetime | None = None
    completed_at: datetime | None = None
    total_lines: int | None = None
    processed_lines: int | None = None
    successful_lines: int | None = None
    failed_lines: int | None = None
    processing_time_ms: int | None = None
    lines_per_second: float | None = None
    deleted: bool = False
    skipped_lines: int | None = None
    continuation_lines: int | None = None
    success_rate: float | None = None
    start_line: int | None = None
    end_line: int | None = None
    bytes_read: int | None = None
    bytes_per_second: float | None = None
    total_entries: int | None = None
    saved_entries: int | None = None
    failed_entries: int | None = None
    batches: int | None = None
    average_save_ms: float | None = None
    error_count: int | None = None
    inferred_timestamps: int | None = None
    split_traces: int | None = None
    level_counts: dict[str, int] | None = None


class JobStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, job: Job, **changes) -> Job:
        job = replace(job, **changes, updated_at=datetime.now(timezone.utc).replace(tzinfo=None))
        self.spark.createDataFrame([tuple(asdict(job).values())], SCHEMA).write.mode("append").parquet(self.path)
        return job

    def table(self) -> DataFrame:
        """The latest row of every job that isn't deleted."""
        try:
            rows = self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing saved yet
            rows = self.spark.createDataFrame([], SCHEMA)
        last = Window.partitionBy("job_id").orderBy(F.desc("updated_at"), F.desc("progress"))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1 and not deleted").drop("_n")

    def find(self, job_id: str) -> Job:
        job = self.get(job_id)
        if job is None:
            raise JobNotFoundError(job_id)
        return job

    def get(self, job_id: str) -> Job | None:
        row = self.table().where(F.col("job_id") == job_id).first()
        return row and Job(**row.asDict())

    def by_status(self, status: str) -> DataFrame:
        return self.table().where(F.col("status") == status)

    def recent(self, hours: int = 24) -> DataFrame:
        return self.table().where(F.col("updated_at") > F.lit(datetime.now(timezone.utc).replace(tzinfo=None) - timedelta(hours=hours)))

    def delete(self, job_id: str) -> None:
        self.save(self.find(job_id), deleted=True)
