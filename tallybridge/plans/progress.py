"""Progress of long steps: marks that only rise, and the share of a step's tasks that are done."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession


class Marks:
    """Calls ``tell(per cent, what)`` whenever the per cent rises, from whichever thread."""

    def __init__(self, tell: Callable[[int, str], None] | None):
        self.tell, self.last, self.lock, self.most = tell, -1, threading.Lock(), 0

    def __call__(self, done: float, what: str) -> None:
        with self.lock:
            if self.tell and int(done) > self.last:
                self.last = int(done)
                self.tell(self.last, what)

    def left(self, rows: int, low: int, high: int, what: str) -> None:
        """A mark between ``low`` and ``high`` by how many of the most ``rows`` told so far are left."""
        self.most = max(self.most, rows)
        self(low + (high - low) * (1 - rows / self.most if self.most else 1), what)

    @contextlib.contextmanager
    def within(self, spark: SparkSession, low: int, high: int, what: str, every: float = 0.2) -> Iterator[None]:
        """Marks from ``low`` to ``high`` by the tasks done of the jobs that the body starts; asking for them starts none."""
        if self.tell is None:
            yield
            return
        context, group, over = spark.sparkContext, f"tallybridge-{uuid.uuid4().hex[:8]}", threading.Event()
        before = context.getLocalProperty("spark.jobGroup.id")
        context.setLocalProperty("spark.jobGroup.id", group)
        tracker = context.statusTracker()

        def watch() -> None:
            while not over.wait(every):
                stages = {s for j in tracker.getJobIdsForGroup(group) for s in getattr(tracker.getJobInfo(j), "stageIds", ())}
                told = [x for x in map(tracker.getStageInfo, stages) if x is not None]
                if total := sum(x.numTasks for x in told):
                    self(low + (high - low - 1) * sum(x.numCompletedTasks for x in told) / total, what)

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()
            context.setLocalProperty("spark.jobGroup.id", before)
            self(high, what)
