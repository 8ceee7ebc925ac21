"""Folder ingest as a stream of files, change status, and spikes over event time."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def start_folder_job(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, fmt: str = "csv", recursive: bool = True, continuous: bool = False):
    """A job that appends new files of a folder to a Parquet table, each file once. Ends when all are in, unless continuous."""
    source = spark.readStream.format(fmt).schema(schema).option("header", True).option("recursiveFileLookup", recursive).load(folder).withColumn("_file", F.col("_metadata.file_path"))
    writer = source.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="10 seconds") if continuous else writer.trigger(availableNow=True)).start()


class JobLog(StreamingQueryListener):
    """What all jobs of a session do: totals for as long as they run, the last ``kept`` log lines of each, and callbacks
    that are given every event as (job, level, message). An error in a callback is logged and stops nothing."""

    def __init__(self, kept: int = 1000) -> None:
        super().__init__()
        self.kept, self.jobs, self.listeners, self._lock = kept, {}, [], threading.Lock()

    def attach(self, spark: SparkSession) -> JobLog:
        spark.streams.addListener(self)
        return self

    def listen(self, callback: Callable[[str, str, str], None]) -> None:
        self.listeners.append(callback)

    def _note(self, job: str, level: str, message: str, **change) -> None:
        with self._lock:
            state = self.jobs.setdefault(job, {"id": job, "name": None, "active": True, "rows": 0, "batches": 0, "error": None, "log": deque(maxlen=self.kept)})
            state["log"].append({"time": datetime.now(timezone.utc).isoformat(), "level": level, "message": message})
            for k, v in change.items():
                state[k] = state[k] + v if k in ("rows", "batches") else v
        for callback in self.listeners:
            try:
                callback(job, level, message)
            except Exception as error:  # foreign code
                with self._lock:
                    state["log"].append({"time": datetime.now(timezone.utc).isoformat(), "level": "error", "message": f"callback: {error}"})

    def onQueryStarted(self, event) -> None:
        self._note(str(event.id), "info", "started", name=event.name, active=True)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._note(str(p.id), "info", f"batch {p.batchId}: {p.numInputRows} rows", rows=p.numInputRows, batches=int(p.numInputRows > 0))

    def onQueryIdle(self, event) -> None:
        self._note(str(event.id), "debug", "idle")

    def onQueryTerminated(self, event) -> None:
        self._note(str(event.id), "error" if event.exception else "info", event.exception or "ended", active=False, error=event.exception)

    def list(self) -> list[dict]:
        """All jobs seen so far, without their logs."""
        with self._lock:
            return [{k: v for k, v in s.items() if k != "log"} for s in self.jobs.values()]

    def logs(self, job: str) -> list[dict]:
        with self._lock:
            return list(self.jobs[job]["log"]) if job in self.jobs else []


def job_status(query, log: JobLog | None = None) -> dict:
    """id, active, rows and batches, and the error if there is one. Spark itself keeps the last batches only; rows of
    longer jobs are counted by a JobLog."""
    state = {"id": str(query.id), "active": query.isActive, "error": str(query.exception()) if query.exception() else None}
    if log is not None:
        seen = next((j for j in log.list() if j["id"] == state["id"]), {"rows": 0, "batches": 0})
        return {**state, "rows": seen["rows"], "batches": seen["batches"]}
    done = query.recentProgress
    return {**state, "rows": sum(p["numInputRows"] for p in done), "batches": len(done)}


def cancel(query) -> None:
    query.stop()


def ingested_files(spark: SparkSession, target: str) -> DataFrame:
    """(file, rows_inserted)."""
    return spark.read.parquet(target).groupBy(F.element_at(F.split("_file", "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("rows_inserted"))


def change_status(table: DataFrame, name: str, key: str, ts: str, now: str) -> DataFrame:
    """(table_name, last_id, rows, lag_s): how far a table is behind a given time."""
    lag = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.max(ts).cast("timestamp"))
    return table.agg(F.lit(name).alias("table_name"), F.max(key).alias("last_id"), F.count(F.lit(1)).alias("rows"), lag.alias("lag_s"))


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "2 days", key: str | None = None) -> DataFrame:
    """(start, n) per event-time window, for batches and streams alike; in a stream rows later than ``late`` are dropped
    and their windows' state with them."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width), *([key] if key else [])).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *([key] if key else []), "n")
