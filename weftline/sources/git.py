"""Output of git as tables: framed logs, porcelain blame and added lines of diffs.

The texts are read with ``spark.read.text`` or come as columns; parsing stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that frame records and fields of ``git log --name-only`` with a matching format.
RECORD, FIELD = "\x1e", "\x1f"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``(sha, author_email, author_time, message, files)`` from a log with ``%x1e%H%x1f%ae%x1f%at%x1f%s`` and name lists.

    Records without four fields are skipped; a time that isn't a number is null.
    """
    raw = spark.read.option("lineSep", RECORD).text(path).where(F.length("value") > 0)
    return parse_log(raw)


def parse_log(raw: DataFrame) -> DataFrame:
    """The same from a column ``value`` with one record per row."""
    head = F.substring_index("value", "\n", 1)
    part = F.split(head, FIELD)
    names = F.filter(F.transform(F.split(F.regexp_replace("value", r"^[^\n]*\n?", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = raw.where(F.size(part) == 4)
    return rows.select(
        part[0].alias("sha"), part[1].alias("author_email"), part[2].try_cast("bigint").alias("author_time"), part[3].alias("message"), names.alias("files")
    )


def commit_files(log: DataFrame) -> DataFrame:
    """``(commit_sha, file_path)`` of a parsed log, once each."""
    return log.select(F.col("sha").alias("commit_sha"), F.explode("files").alias("file_path")).distinct()


def blame_shares(blame: DataFrame) -> DataFrame:
    """``(file_path, author_email, line_count, percentage)`` from porcelain lines ``(file_path, pos, line)``.

    A commit's mail is stated once and holds for its later lines; lines of unknown commits count for no one.
    """
    w = Window.partitionBy("file_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sha = F.when(F.col("line").rlike(r"^[0-9a-f]{40} \d+ \d+"), F.substring("line", 1, 40))
    rows = blame.withColumn("sha", F.last(sha, ignorenulls=True).over(w))
    mails = rows.where("line like 'author-mail %'").groupBy("file_path", "sha").agg(F.min(F.regexp_extract("line", r"^author-mail <?([^>]*)>?$", 1)).alias("author_email"))
    counts = rows.where(F.col("line").startswith("\t")).groupBy("file_path", "sha").agg(F.count("*").alias("n"))
    sums = counts.join(mails, ["file_path", "sha"]).groupBy("file_path", "author_email").agg(F.sum("n").alias("line_count"))
    total = F.sum("line_count").over(Window.partitionBy("file_path"))
    return sums.withColumn("percentage", F.col("line_count") / total * 100)


def added_lines(diff: DataFrame) -> DataFrame:
    """``(file, line_no, text)`` of the added lines of unified diffs ``(doc_id, text)``."""
    rows = diff.where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("file", F.last(F.when(F.col("line").startswith("+++ "), F.regexp_replace("line", r"^\+\+\+ (?:b/)?", "")), ignorenulls=True).over(w))
    hunk = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1)
    rows = rows.withColumn("start", F.when(hunk != "", hunk.cast("int"))).withColumn("hunk", F.count("start").over(w))
    counted = F.when(F.col("start").isNull() & ~F.col("line").startswith("-") & ~F.col("line").startswith("+++") & ~F.col("line").startswith("\\"), 1).otherwise(0)
    inner = Window.partitionBy("doc_id", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("line_no", F.first("start", ignorenulls=True).over(inner) + F.sum(counted).over(inner) - 1)
    added = rows.where(F.col("line").startswith("+") & ~F.col("line").startswith("+++ ") & (F.col("hunk") > 0))
    return added.select("file", "line_no", F.substring("line", 2, 1 << 30).alias("text"))
