"""A job handle: submit, status, one result, close."""

from __future__ import annotations

import enum
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Row, SparkSession

from millrace.plans import mapreduce
from millrace.sources.text import generated_lines, read_lines
from millrace.storage import discard, new_path


class State(enum.Enum):
    PENDING = "pending"
    RUNNING = "running"
    DONE = "done"
    FAILED = "failed"


class NotReady(RuntimeError):
    """The result was asked for before the job was done."""


class Gone(LookupError):
    """The result was taken already, or the job was closed."""


class Unknown(LookupError):
    """No job of this process has the id."""


_jobs: dict[str, JobHandle] = {}


def find(job_id: str) -> JobHandle:
    """The job with this id, until it is closed."""
    try:
        return _jobs[job_id]
    except KeyError:
        raise Unknown(job_id) from None


class JobHandle:
    """A running job. The result waits in the shared folder until it is taken, once.

    deadline: seconds for one attempt; attempts: how often the job is run until
    it succeeds. (Single tasks are repeated by Spark, by spark.task.maxFailures.)
    """

    def __init__(self, spark: SparkSession, plan: Callable[[], DataFrame], deadline: float | None = None, attempts: int = 1):
        if attempts < 1:
            raise ValueError(f"attempts must be 1 or more, not {attempts}")
        self.spark, self.id = spark, uuid.uuid4().hex
        self.state, self.error, self.attempt = State.PENDING, None, 0
        self._path = new_path(spark, f"job-{self.id}")
        self._plan, self._deadline, self._attempts = plan, deadline, attempts
        self._taken, self._stopped, self._lock = False, False, threading.Lock()
        _jobs[self.id] = self
        self._thread = InheritableThread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        while not self._stopped and self.attempt < self._attempts:
            self.attempt += 1
            if self._try():
                return
        self.state = State.FAILED

    def _try(self) -> bool:
        group = f"{self.id}-{self.attempt}"
        self.spark.sparkContext.setJobGroup(group, f"millrace job {self.id}, attempt {self.attempt}", interruptOnCancel=True)
        late = threading.Event()

        def too_late() -> None:
            late.set()
            self.spark.sparkContext.cancelJobGroup(group)

        timer = threading.Timer(self._deadline, too_late) if self._deadline is not None else None
        if timer:
            timer.daemon = True
            timer.start()
        self.state = State.RUNNING
        try:
            self._plan().write.mode("overwrite").parquet(self._path)
            if late.is_set():
                raise TimeoutError("the deadline passed")
            self.state = State.DONE
            return True
        except Exception as e:  # noqa: BLE001  the handle reports it
            self.error = TimeoutError("the deadline passed") if late.is_set() else e
            return False
        finally:
            if timer:
                timer.cancel()

    def cancel(self) -> None:
        """Stop the attempt that runs, and start no other."""
        self._stopped = True
        self.spark.sparkContext.cancelJobGroup(f"{self.id}-{self.attempt}")

    def status(self) -> dict:
        """State and the share of tasks that are done, of the first stage (map) and of the others (reduce)."""
        tracker = self.spark.sparkContext.statusTracker()
        done, total = [0, 0], [0, 0]
        for job in sorted(tracker.getJobIdsForGroup(f"{self.id}-{self.attempt}")):
            info = tracker.getJobInfo(job)
            for stage in sorted(info.stageIds) if info else []:
                s = tracker.getStageInfo(stage)
                if s:
                    k = int(total[0] > 0)
                    done[k] += s.numCompletedTasks
                    total[k] += s.numTasks
        share = [1.0 if self.state is State.DONE else d / t if t else 0.0 for d, t in zip(done, total)]
        return {"id": self.id, "status": self.state.value, "map_progress": share[0], "reduce_progress": share[1]}

    def wait(self, timeout: float | None = None) -> JobHandle:
        self._thread.join(timeout)
        return self

    def result(self) -> Iterator[str]:
        """The sorted lines, once, one partition in memory at a time; when all are read the files go.

        The result counts as taken when its first line has been read, so one
        that can't be opened can be asked for again.
        """
        with self._lock:
            if self._taken:
                raise Gone(self.id)
            if self.state is State.FAILED:
                raise RuntimeError(f"job {self.id} failed") from self.error
            if self.state is not State.DONE:
                raise NotReady(self.id)
            found = mapreduce.in_order(self.spark.read.schema("line string").parquet(self._path)).toLocalIterator()
            first = next(found, None)
            self._taken = True
        return self._lines(first, found)

    def _lines(self, first: Row | None, found: Iterator[Row]) -> Iterator[str]:
        if first is not None:
            yield first.line
        for r in found:
            yield r.line
        discard(self.spark, [self._path])

    def close(self) -> None:
        """Stop the job if it runs, delete its files and forget its id."""
        self.cancel()
        self._thread.join()
        self._taken = True
        _jobs.pop(self.id, None)
        discard(self.spark, [self._path])


def submit(
    spark: SparkSession,
    map: Callable,  # noqa: A002
    reduce: Callable,
    lines: DataFrame | str | None = None,
    generate_mb: int | None = None,
    num_reduces: int | None = None,
    value_order: bool = False,
    deadline: float | None = None,
    attempts: int = 2,
    most_ratio: float | None = None,
) -> JobHandle:
    """Start a job on ``lines`` (column value, or a path of text files) or, without it, on generated lines.

    deadline and attempts: see ``JobHandle``; most_ratio: see ``partitions``.
    """
    num_reduces = mapreduce.check_reduces(spark, num_reduces)
    if lines is None and generate_mb is None:
        raise ValueError("a job needs lines or generate_mb")
    if lines is None:
        given = generated_lines(spark, generate_mb)
    else:
        given = read_lines(spark, lines) if isinstance(lines, str) else lines
    return JobHandle(spark, lambda: mapreduce.partitions(given.select("value"), map, reduce, num_reduces, value_order, most_ratio=most_ratio), deadline, attempts)
