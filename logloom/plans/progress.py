"""What a job's Spark tasks tell of its progress while it runs."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import SparkSession

from .jobs import Job, JobStore, progress

#: Seconds between two looks, and percent that a job must have gained to be saved again.
EVERY, STEP = 1.0, 10


def tasks_of(context: SparkContext, group: str) -> tuple[int, int]:
    """(ended, all) tasks of the stages known so far of a group's jobs."""
    tracker, done, total = context.statusTracker(), 0, 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            seen = tracker.getStageInfo(stage)
            if seen:
                done, total = done + seen.numCompletedTasks, total + seen.numTasks
    return done, total


@contextmanager
def watched(spark: SparkSession, jobs: JobStore, job: Job, every: float = EVERY, step: int = STEP) -> Iterator[None]:
    """What runs inside belongs to the job's group of Spark jobs, and a thread saves the job's progress.

    Stages become known one after the other, so a share of tasks may fall; what is saved only rises.
    """
    context, over = spark.sparkContext, threading.Event()

    def look() -> None:
        saved = job.progress
        while not over.wait(every):
            done, total = tasks_of(context, job.job_id)
            now = progress(done, total)
            if now >= saved + step and now < 95 and not over.is_set():
                jobs.save(job, progress=now, message=f"{done} of {total} tasks")
                saved = now

    before = [context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")]
    context.setJobGroup(job.job_id, f"ingest of {job.file_name}")
    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
        for k, v in zip(("spark.jobGroup.id", "spark.job.description"), before, strict=True):
            context.setLocalProperty(k, v)
