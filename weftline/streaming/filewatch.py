"""A stream of file changes reduced to the last change of each task, and its application in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGE = "kind string, path string, seen timestamp"

#: Fixed value: names of the files of a task that matter.
TASK_FILE = r"(-tasks|-plan|-reference|-context-log)\.md$|-provenance\.log$"


def changes(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON lines ``{kind, path, seen}`` from files that appear in a folder."""
    reader = spark.readStream.schema(CHANGE)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(folder)


def task_changes(stream: DataFrame) -> DataFrame:
    """Changes of task files with ``task``, the name of the folder that holds the file."""
    parts = F.split("path", "/")
    return stream.where(F.col("path").rlike(TASK_FILE) & (F.size(parts) > 1)).withColumn("task", F.element_at(parts, -2))


def last_seen(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """``(task, seen, n)``: state per task. With a watermark, changes that are later than it allows are dropped by Spark's rule for windows of a day."""
    rows = task_changes(stream)
    if watermark:
        rows = rows.withWatermark("seen", watermark)
        return rows.groupBy(F.window("seen", "1 day").alias("day"), "task").agg(F.max("seen").alias("seen"), F.count("*").alias("n")).select("task", "seen", "n", F.col("day.start").alias("day"))
    return rows.groupBy("task").agg(F.max("seen").alias("seen"), F.count("*").alias("n"))


def reduce_batch(state: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(new state, affected tasks)`` of a state ``(task, seen)`` and a batch of changes; other tasks are kept."""
    rows = task_changes(batch)
    new = rows.groupBy("task").agg(F.max("seen").alias("seen"))
    both = state.select("task", "seen").unionByName(new).groupBy("task").agg(F.max("seen").alias("seen"))
    return both, new.select("task")


def watch(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False, debounce: str = "300 milliseconds") -> StreamingQuery:
    """Call ``callback(affected, batch_id)`` for every batch of changes, with each affected task once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        callback(task_changes(batch).groupBy("task").agg(F.max("seen").alias("seen")), batch_id)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=debounce)).start()
