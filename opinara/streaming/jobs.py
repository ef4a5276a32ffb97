"""Background jobs: a Spark job group with progress and cancellation."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession

Progress = Callable[[int, int, str], None]


@dataclass
class Job:
    """One run of a function; ``state`` is queued, running, done, failed or cancelled."""

    name: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    state: str = "queued"
    done: int = 0
    total: int = 0
    message: str = ""
    error: str | None = None
    result: object = None
    _stop: threading.Event = field(default_factory=threading.Event)
    _thread: threading.Thread | None = None

    def progress(self, done: int, total: int, message: str) -> None:
        """Called by the function; ends it where it was cancelled."""
        self.done, self.total, self.message = done, total, message
        if self._stop.is_set():
            raise InterruptedError(self.name)

    def wait(self, seconds: float | None = None) -> Job:
        if self._thread:
            self._thread.join(seconds)
        return self


def start(spark: SparkSession, name: str, work: Callable[[Progress], object]) -> Job:
    """Run ``work(progress)`` in the background; its Spark jobs belong to the job's group."""
    job = Job(name)

    def run() -> None:
        spark.sparkContext.setJobGroup(job.id, name, interruptOnCancel=True)
        job.state = "running"
        try:
            job.result = work(job.progress)
            job.state = "done"
        except Exception as problem:  # whatever ended the work is its outcome
            job.state = "cancelled" if job._stop.is_set() else "failed"
            job.error = str(problem)

    job._thread = InheritableThread(target=run, name=name, daemon=True)
    job._thread.start()
    return job


def cancel(spark: SparkSession, job: Job) -> None:
    """Stop the job's running Spark stages; nothing new of it starts."""
    job._stop.set()
    spark.sparkContext.cancelJobGroup(job.id)
