"""Time limits of runs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")

# Seconds that a run, a request and a comparison may take.
RUN_SECONDS, REQUEST_SECONDS, COMPARE_SECONDS = 3 * 3600, 600, 1200


def within(spark: SparkSession, seconds: float, action: Callable[[], T]) -> T:
    """What action gives back.  Spark jobs that it has running when the time is up are cancelled, and TimeoutError is raised."""
    tag, done, over = f"deadline-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        wait = seconds
        while not done.wait(wait):
            over.set()
            spark.sparkContext.cancelJobsWithTag(tag)  # again and again: the next job may not have begun yet
            wait = 0.5

    spark.sparkContext.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        out = action()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"not done in {seconds} seconds") from e
        raise
    finally:
        done.set()
        spark.sparkContext.removeJobTag(tag)
    return out
