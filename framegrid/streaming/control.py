"""Cancelling: a job's Spark work runs under its tag, and cancelling ends all of it, on whatever thread."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def _tag(job_id: str) -> str:
    return f"framegrid-job-{job_id}"


def run_job(spark: SparkSession, job_id: str, action: Callable[[], T]) -> T:
    """``action()`` with its Spark jobs under the job's tag; its error, if it is cancelled, comes through."""
    spark.sparkContext.addJobTag(_tag(job_id))
    try:
        return action()
    finally:
        spark.sparkContext.removeJobTag(_tag(job_id))


def cancel_job(spark: SparkSession, job_id: str) -> None:
    """End the running Spark jobs of ``job_id``; those of others go on."""
    spark.sparkContext.cancelJobsWithTag(_tag(job_id))
