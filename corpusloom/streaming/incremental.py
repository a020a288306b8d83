"""Incremental runs: new files only, resumable, with the same operators as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from corpusloom.schemas import parse


def resumable(
    spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, fmt: str = "json", rows: int | None = None
) -> StreamingQuery:
    """Runs `step` over files not seen before and appends to `target`; ends when there are none left.

    The checkpoint holds which files are done, so a run that was stopped goes on where it was.
    """
    reader = spark.readStream.schema(parse(schema)).format(fmt)
    stream = reader.option("maxFilesPerTrigger", rows).load(source) if rows else reader.load(source)

    def sink(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("append").format(fmt).save(target)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after_suffix(key: Column, start: int) -> Column:
    """Whether the number after the last underscore of an id is `start` or more."""
    return F.element_at(F.split(key, "_"), -1).try_cast("int") >= start


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: events, and the sum of their values, by type and time window; works on streams and tables."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", every)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


class Progress(StreamingQueryListener):
    """Calls `report(query name, rows so far)` after every batch; register with `spark.streams.addListener`."""

    def __init__(self, report: Callable[[str, int], None]):
        self.report, self.rows = report, {}

    def onQueryStarted(self, event):
        self.rows[str(event.runId)] = 0

    def onQueryProgress(self, event):
        p = event.progress
        self.rows[str(p.runId)] = self.rows.get(str(p.runId), 0) + p.numInputRows
        self.report(p.name or str(p.id), self.rows[str(p.runId)])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.rows.pop(str(event.runId), None)
