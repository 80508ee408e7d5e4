"""Outputs of other repository-mapping tools as ranked tables ``(pos, file, symbol)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _lines(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))


def prose_map(docs: DataFrame) -> DataFrame:
    """Files as lines that end with a colon, and below them indented definitions marked with a bar."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    file = F.regexp_extract("line", r"^(\S.*\.\w+):\s*$", 1)
    rows = _lines(docs).withColumn("file", F.last(F.when(file != "", file), ignorenulls=True).over(w))
    symbol = F.regexp_extract("line", r"^[│|]\s*(?:async\s+)?(?:def|class|function|func|fn)\s+([\w$]+)", 1)
    return rows.where(symbol != "").select("doc_id", "pos", "file", symbol.alias("symbol"))


def legend_csv(docs: DataFrame) -> DataFrame:
    """Rows ``file,symbol`` whose files start with a legend's letters: ``@a=src/`` lines, the longest letters first."""
    rows = _lines(docs)
    legend = rows.where(F.col("line").rlike(r"^@\w+=")).select("doc_id", F.regexp_extract("line", r"^(@\w+)=", 1).alias("mark"), F.regexp_extract("line", r"=(.*)$", 1).alias("prefix"))
    data = rows.where(~F.col("line").startswith("@") | ~F.col("line").contains("=")).where("line like '%,%'").select("doc_id", "pos", F.substring_index("line", ",", 1).alias("f"), F.regexp_extract("line", r",(.*)$", 1).alias("symbol"))
    hit = data.join(legend, "doc_id").where(F.col("f").startswith(F.col("mark")))
    best = hit.groupBy("doc_id", "pos").agg(F.max_by(F.struct("mark", "prefix"), F.length("mark")).alias("m"))
    out = data.join(best, ["doc_id", "pos"], "left_outer")
    file = F.when(F.col("m").isNotNull(), F.concat(F.col("m.prefix"), F.expr("substring(f, length(m.mark) + 1)"))).otherwise(F.col("f"))
    return out.select("doc_id", "pos", file.alias("file"), "symbol")


def xml_paths(docs: DataFrame) -> DataFrame:
    """Files of ``<file path="...">`` elements in order."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r'<file path="([^"]+)"'), F.lit(1))).alias("pos", "file"))


def json_files(docs: DataFrame) -> DataFrame:
    """Files of a JSON array of objects with ``filename`` in order; other texts give nothing."""
    parsed = F.from_json("text", "array<struct<filename: string>>")
    return docs.where("text is not null").select("doc_id", F.posexplode(parsed).alias("pos", "j")).where("j.filename is not null").select("doc_id", "pos", F.col("j.filename").alias("file"))


def file_order(ranked: DataFrame) -> DataFrame:
    """Files of a ranked list of symbols in the order of their first appearance."""
    return ranked.groupBy("doc_id", "file").agg(F.min("pos").alias("pos"))
