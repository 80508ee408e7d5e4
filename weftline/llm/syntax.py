"""Source files that do not parse: a fault per file and rates per repository and language."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from weftline.llm.lexers import check

    for batch in batches:
        faults = [check(text, lang) for text, lang in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        reason = pa.array([f and f[0] for f in faults], pa.string())
        at = pa.array([f and f[1] for f in faults], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), reason, at], ["file_id", "fault", "at"])


def checked_files(files: DataFrame, contents: DataFrame, lang_map: DataFrame) -> DataFrame:
    """``(file_id, repo, language, fault, at)`` for every file that has a text; ``fault`` is null where the text is valid.

    The language is the one that ``lang_map(lang, ext)`` gives for the extension of ``path``, compared without
    case; files of other extensions and null texts are left out.  Of different texts or paths of one file the
    smallest counts, so exact repeats collapse.  Empty tables give no rows.
    """
    paths = files.where("id is not null and path is not null").groupBy(F.col("id").alias("file_id")).agg(F.min(F.struct("path", "repo")).alias("s"))
    ext = F.lower(F.regexp_extract("s.path", r"(\.[^./\\]+)$", 1))
    # lang_map lists the languages of the engine; it doesn't grow with the data.
    langs = lang_map.where("ext is not null and lang is not null").groupBy(F.lower("ext").alias("ext")).agg(F.min("lang").alias("language"))
    known = paths.select("file_id", F.col("s.repo").alias("repo"), ext.alias("ext")).join(langs, "ext").select("file_id", "repo", "language")
    texts = contents.where("content is not null and file_id is not null").groupBy("file_id").agg(F.min("content").alias("content"))
    rows = texts.join(known, "file_id").select("file_id", "repo", "language", "content")
    checked = rows.select(F.struct("file_id", "repo", "language").alias("f"), "language", "content").mapInArrow(
        _check, "file_id struct<file_id: long, repo: string, language: string>, fault string, at int"
    )
    return checked.select("file_id.*", "fault", "at")


def fault_rates(checked: DataFrame) -> DataFrame:
    """Per repository and language the number of texts, of invalid ones and their share."""
    return checked.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count("fault").alias("n_invalid")).withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
