"""The event log as a stream: emit, format, filter and drain.

A conversion's progress is rows of (event_id, ts, stage, message, level, progress). Written to a folder, they can be
followed with Structured Streaming; observers are sinks.
"""

from __future__ import annotations

import datetime
import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR")


#: One emitted event, as a row.
EVENT = "event_id long, ts timestamp, stage string, message string, level string, progress double"
Listener = Callable[[dict], None]


class Progress:
    """What a job says of itself: each event goes to every listener, in the order in which they were attached.

    A listener that fails is reported by the log and does not stop the job, nor the listeners after it.
    """

    def __init__(self):
        self.listeners: list[Listener] = []
        self.sent = 0

    def attach(self, listener: Listener) -> Listener:
        """Add a listener; one that is attached already is not added again."""
        if listener not in self.listeners:
            self.listeners.append(listener)
        return listener

    def detach(self, listener: Listener) -> None:
        """Take a listener away; an unknown one is no error."""
        if listener in self.listeners:
            self.listeners.remove(listener)

    def emit(self, stage: str, message: str, level: str = "INFO", progress: float | None = None) -> None:
        if level not in LEVELS:
            raise ValueError(f"unknown level {level}")
        event = {"event_id": self.sent, "ts": datetime.datetime.now(), "stage": stage, "message": message, "level": level, "progress": progress}
        self.sent += 1
        for listener in list(self.listeners):
            try:
                listener(event)
            except Exception:  # noqa: BLE001  who listens must not stop who works
                logging.getLogger(__name__).exception("a listener failed")


def log_listener(logger: logging.Logger | None = None) -> Listener:
    """Events as lines of a log, at their level."""
    to = logger or logging.getLogger("quire")
    return lambda e: to.log(getattr(logging, e["level"]), "[%s] %s", e["stage"], e["message"])


class TableListener:
    """Events gathered, and written as a table that :func:`read` follows."""

    def __init__(self):
        self.rows: list[dict] = []

    def __call__(self, event: dict) -> None:
        self.rows.append(event)

    def write(self, spark: SparkSession, path: str) -> None:
        names = [f.split()[0] for f in EVENT.split(", ")]
        spark.createDataFrame([tuple(r[n] for n in names) for r in self.rows], EVENT).coalesce(1).write.mode("append").parquet(path)
        self.rows.clear()


def read(spark: SparkSession, path: str, schema: StructType, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet events as a stream."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def progress_line(stage: Column, message: Column, progress: Column) -> Column:
    """``[stage] [ 40%] message``."""
    pct = F.when(progress.isNotNull(), F.format_string("[%3d%%] ", F.bround(progress * 100).cast("int"))).otherwise("")
    return F.concat(F.lit("["), stage, F.lit("] "), pct, message)


def visible(events: DataFrame, verbose: bool = False) -> DataFrame:
    """Events without debugging ones, unless ``verbose``."""
    return events if verbose else events.where("level <> 'DEBUG'")


def drain(events: DataFrame, observer: Callable[[DataFrame, int], None], checkpoint: str, every: str = "1 second", once: bool = False) -> StreamingQuery:
    """Hand each micro-batch to ``observer``, in order; a failing observer stops the query."""
    w = events.writeStream.foreachBatch(observer).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def stage_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", stage: str = "stage") -> DataFrame:
    """Counts by stage and time window; state of windows past the watermark is dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", size), stage).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), stage, "n")
