"""Progress of the jobs of a block of code, as tasks done of tasks known."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

Tell = Callable[[int, int], None]


@contextmanager
def progress(spark: SparkSession, tell: Tell | None, every: float = 0.5) -> Iterator[None]:
    """Calls tell(done, total) while the block runs, and at its end with both the same. The total grows as stages begin."""
    if tell is None:
        yield
        return
    context, group, over = spark.sparkContext, f"quillspark-{uuid.uuid4().hex}", threading.Event()
    tracker, before = context.statusTracker(), context.getLocalProperty("spark.jobGroup.id")
    most = 0

    def count() -> tuple[int, int]:
        stages = {s for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds}
        known = [x for s in stages if (x := tracker.getStageInfo(s))]
        return sum(x.numCompletedTasks for x in known), sum(x.numTasks for x in known)

    def watch() -> None:
        nonlocal most
        while not over.wait(every):
            done, total = count()
            most = max(most, total)
            if total:
                tell(done, most)

    context.setLocalProperty("spark.jobGroup.id", group)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
        most = max(most, count()[1])
    finally:
        over.set()
        watcher.join()
        context.setLocalProperty("spark.jobGroup.id", before)
    tell(most, most)
