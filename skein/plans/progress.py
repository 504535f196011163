"""Lines in the log while records are read."""

from __future__ import annotations

import logging
import threading
import uuid

from pyspark.sql import SparkSession


class Progress:
    """Logs each ``every`` records that the jobs started inside read, as the driver hears of
    them: ``with Progress(spark, log, "read sets", 1_000_000): ...``."""

    def __init__(self, spark: SparkSession, log: logging.Logger, what: str, every: int, seconds: float = 1.0):
        self.spark, self.log, self.what, self.every, self.seconds = spark, log, what, every, seconds
        self.group, self.told, self.done = f"skein-{uuid.uuid4().hex}", 0, threading.Event()

    def read(self) -> int:
        """Records read so far by the group's stages."""
        tracker, store, n = self.spark.sparkContext.statusTracker(), self.spark.sparkContext._jsc.sc().statusStore(), 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else []:
                if tracker.getStageInfo(stage):
                    n += store.lastStageAttempt(stage).inputRecords()
        return n

    def tell(self) -> None:
        n = self.read() // self.every
        for k in range(self.told + 1, n + 1):
            self.log.info("%s %s processed", f"{k * self.every:,}", self.what)
        self.told = max(self.told, n)

    def _poll(self) -> None:
        while not self.done.wait(self.seconds):
            try:
                self.tell()
            except Exception:  # a stage that goes while it is asked for; the next time will do
                continue

    def __enter__(self) -> Progress:
        self.spark.sparkContext.setJobGroup(self.group, self.what)
        self.thread = threading.Thread(target=self._poll, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self.done.set()
        self.thread.join()
        self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        if kind is None:
            self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
            self.tell()
