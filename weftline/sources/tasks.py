"""Plan documents and source files on a file system as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import ENDINGS, language, tail_lines

#: Fixed value: the files that make up a task, by the ending of their name.
PARTS = r"^(.+?)-(tasks\.md|plan\.md|reference\.md|context-log\.md|provenance\.log)$"


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, lang, size, mtime, hash, content)`` of the source files below a folder; paths are relative, hashes of raw bytes.

    Bytes that aren't UTF-8 are replaced in ``content``.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(ENDINGS) + "}").load(root)
    base = root.rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    return rows.select(path.alias("path"), language(F.col("path")).alias("lang"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def task_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """``(root, priority, task, part, path, mtime, text)`` of all task files; later roots have higher priority."""
    out = None
    for i, root in enumerate(roots):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*-*.{md,log}").load(root)
        name = F.substring_index("path", "/", -1)
        rows = rows.where(name.rlike(PARTS)).select(
            F.lit(root).alias("root"), F.lit(i).alias("priority"), F.regexp_extract(name, PARTS, 1).alias("task"), F.regexp_extract(name, PARTS, 2).alias("part"), "path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def discover(parts: DataFrame) -> DataFrame:
    """``(task, root, text, mtime, tail, error)``, one row per task; of a task in several roots the last root counts.

    ``mtime`` is the newest of its files, ``tail`` the last five lines of its provenance log.  A task without a
    task list is an error row, not a failure.
    """
    best = parts.groupBy("task").agg(F.max("priority").alias("priority"))
    mine = parts.join(best, ["task", "priority"])
    one = lambda p: F.max(F.when(F.col("part") == p, F.col("text")))
    rows = mine.groupBy("task").agg(F.min("root").alias("root"), one("tasks.md").alias("text"), F.max("mtime").alias("mtime"), one("provenance.log").alias("log"))
    return rows.select("task", "root", "text", "mtime", tail_lines(F.col("log")).alias("tail"), F.when(F.col("text").isNull(), "no task list").alias("error"))
