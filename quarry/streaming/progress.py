"""Progress of searches and other jobs: events of rounds and of stages, given to a callback while they run."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Progress:
    """with Progress(spark, callback) as p: search(..., progress=p.round)

    The callback is given dicts. {"kind": "round", ...} is what a search says of each of its rounds; {"kind": "stage",
    "job", "stage", "tasks", "done", "failed"} comes whenever a stage of the jobs that this thread starts inside the block
    has come further, from Spark's status tracker; {"kind": "end", "error"} ends it. What the callback raises is kept in
    ``errors`` and stops nothing.
    """

    def __init__(self, spark: SparkSession, callback: Callable[[dict], None], every: float = 0.2) -> None:
        self.spark, self.callback, self.every = spark, callback, every
        self.group, self.errors, self._seen, self._stop, self._lock = f"quarry-{uuid.uuid4().hex}", [], {}, threading.Event(), threading.Lock()

    def _tell(self, event: dict) -> None:
        with self._lock:
            try:
                self.callback(event)
            except Exception as error:  # foreign code
                self.errors.append(error)

    def round(self, event: dict) -> None:
        self._tell({"kind": "round", **event})

    def _look(self) -> None:
        tracker = self.spark.sparkContext.statusTracker()
        for job in sorted(tracker.getJobIdsForGroup(self.group)):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else []:
                s = tracker.getStageInfo(stage)
                now = s and (s.numTasks, s.numCompletedTasks, s.numFailedTasks)
                if now and self._seen.get(stage) != now and (now[1] or now[2]):
                    self._seen[stage] = now
                    self._tell({"kind": "stage", "job": job, "stage": stage, "tasks": now[0], "done": now[1], "failed": now[2]})

    def _watch(self) -> None:
        while not self._stop.wait(self.every):
            self._look()

    def __enter__(self) -> Progress:
        context = self.spark.sparkContext
        self._before = context.getLocalProperty("spark.jobGroup.id")
        context.setJobGroup(self.group, "watched")
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self._stop.set()
        self._thread.join()
        self._look()
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", self._before)
        self._tell({"kind": "end", "error": None if error is None else str(error)})
