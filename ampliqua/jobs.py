"""Several runs at once in one session: a job group and a scheduler pool for each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


def side_by_side(spark: SparkSession, tasks: Sequence[tuple[str, Callable[[], object]]], workers: int = 4) -> list[str]:
    """Runs the named tasks, so many at a time; the first line of each one's error, empty if it ended well.

    A task's jobs are in a group and a pool of its name. One that fails takes the rest of its own group with it, and
    nothing of the others. Errors that no input can cause are raised, after all tasks have ended.
    """
    context = spark.sparkContext

    def run(name: str, task: Callable[[], object]) -> str:
        context.setJobGroup(name, name, interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", name)
        try:
            task()
        except (ValueError, PySparkException, OSError) as error:  # a file that isn't there, say
            context.cancelJobGroup(name)
            return str(error).partition("\n")[0] or type(error).__name__
        return ""

    if not tasks:
        return []
    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(run), *t) for t in tasks]]
