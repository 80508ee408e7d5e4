"""JSON lines: journals with archives and transcripts. Blank lines and lines that aren't JSON are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JOURNAL = (
    "id string, ts string, op string, args struct<path: string, lang: string, mtime: bigint, size: bigint, content_hash_before: string, content_hash_after: string>, "
    "prev_user_version int, content_sha string, schema_version int, ack boolean"
)


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of the given schema from plain or gzipped files; the schema is never guessed."""
    rows = spark.read.text(paths).where(F.trim("value") != "").select(F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("j"))
    return rows.where("j is not null and j._bad is null").select("j.*").drop("_bad")


def read_journal(spark: SparkSession, path: str, archives: int = 3, repo: str = "") -> DataFrame:
    """Intents and acknowledgements of a journal and its archives ``path.1.gz`` and up; the order of files doesn't matter."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    names = [path, *(f"{path}.{i}.gz" for i in range(1, archives + 1))]
    there = [n for n in names if (p := jvm.org.apache.hadoop.fs.Path(n)).getFileSystem(conf).exists(p)]
    if not there:
        return spark.createDataFrame([], JOURNAL).withColumn("repo", F.lit(repo))
    return read_json_lines(spark, there, JOURNAL).where("id is not null").withColumn("repo", F.lit(repo))
