"""Opening with progress and cancellation: any Spark action, told of while it runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import SparkSession


class Cancelled(Exception):
    """The action was cancelled by its caller."""


def followed[T](spark: SparkSession, action: Callable[[], T], progress: Callable[[int, int], None] | None = None, cancelled: Callable[[], bool] | None = None, every_s: float = 0.1) -> T:
    """The result of ``action``. ``progress`` is told (tasks done, tasks known) of its jobs as they run; once ``cancelled`` says so, they are cancelled and Cancelled is raised."""
    context, group = spark.sparkContext, f"followed-{uuid.uuid4().hex}"
    result: list[T] = []
    error: list[BaseException] = []

    def run() -> None:
        context.setJobGroup(group, "followed", interruptOnCancel=True)
        try:
            result.append(action())
        except BaseException as e:  # noqa: BLE001 - raised again by the caller's thread
            error.append(e)

    def tell() -> None:
        if progress is None:
            return
        tracker = context.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for s in job.stageIds}
        found = [i for s in stages if (i := tracker.getStageInfo(s))]
        progress(sum(i.numCompletedTasks for i in found), sum(i.numTasks for i in found))

    thread = InheritableThread(target=run, session=spark)
    thread.start()
    stopped = False
    while thread.is_alive():
        thread.join(every_s)
        if not stopped and cancelled is not None and cancelled():
            stopped = True
        if stopped:  # again and again, as an action may have several jobs
            context.cancelJobGroup(group)
        tell()
    if stopped:
        raise Cancelled
    if error:
        raise error[0]
    return result[0]
