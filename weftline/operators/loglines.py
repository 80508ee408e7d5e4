"""Semi-structured log lines into entries with timestamp, level, component and message.

Each line is parsed by itself with a weighted grammar (``functions.logformats``); then lines are put together
to entries.  A log may hold a third of all lines, so it is cut into blocks of consecutive lines; only one row
per block passes from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut

#: Lines of a block.
BLOCK = 4096

PARSED = "log_name string, line_no long, kind string, ts_ms long, level string, component string, message string, unparsed int, text string"


def _parse(batches: Iterator[pa.RecordBatch], rules: tuple = ()) -> Iterator[pa.RecordBatch]:
    from weftline.functions.logformats import LineParser

    parse = LineParser(rules=rules).parse
    names = [part.split()[0] for part in PARSED.split(", ")]
    for batch in batches:
        years = batch.column(3).to_pylist()
        raws = batch.column(2).to_pylist()
        rows = [(*parse(raw, year), (raw or "").rstrip("\r\n")) for raw, year in zip(raws, years, strict=True)]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        order = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, order, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)


def parse_lines(lines: DataFrame, rules: tuple = ()) -> DataFrame:
    """One parsed row per ``(log_name, line_no)``; see ``logformats.LineParser`` for the columns.

    ``text`` is the whole line without its end.  ``rules`` are layouts beyond those of ``logformats.RULES``.
    Repeated lines count once; of different texts for one line the smallest counts.  Rows with a null log or
    line number are left out, a null text is an empty line.  Without ``captured_at`` the year is 1970.
    """
    once = lines.where("log_name is not null and line_no is not null").groupBy("log_name", "line_no").agg(F.min(F.struct("raw", "captured_at")).alias("s"))
    year = F.coalesce(F.year("s.captured_at"), F.lit(1970)).cast("int")
    return once.select("log_name", "line_no", F.col("s.raw").alias("raw"), year.alias("year")).mapInArrow(partial(_parse, rules=rules), PARSED)


def log_entries(lines: DataFrame, block: int = BLOCK, rules: tuple = ()) -> DataFrame:
    """Entries ``(log_name, line_no, last_line, ts_ms, level, component, message)``.

    A line that starts no entry belongs to the entry above it, up to the line before the next entry; lines
    before the first entry belong to none.  An object spread over several lines starts an entry if its lines
    follow each other up to the closing one and give a time and a level.  An empty table gives no entries.
    ``message`` is that of the entry's first line or object; ``whole_entries`` has the lines below it too.
    """
    # Several steps read the parsed lines; they are parsed once and written without their raw text.
    return _assemble(cut(_blocked(parse_lines(lines, rules).drop("text"), block)), block).drop("head_line")


def whole_entries(lines: DataFrame, block: int = BLOCK, rules: tuple = ()) -> DataFrame:
    """``log_entries`` with the text of all their lines: ``message``, ``unparsed`` and ``below``.

    The lines below the first line, or below the object that starts the entry, are appended to ``message`` in
    line order, each after a line feed, with their indentation and without colour codes; blank lines too.  Of
    the object itself the member named as message counts, as in an object on one line.  ``unparsed`` are the
    spans ``(line_no, start, stop, text)`` that no rule of the grammar explains, in line order: characters
    ``start`` to ``stop``, from 0 and without ``stop``, of the line without its end.
    ``below`` has ``(line_no, kind)`` of the lines below that a rule for traces or indented text knows.
    """
    parsed = cut(_blocked(parse_lines(lines, rules), block))
    heads = cut(_assemble(parsed, block))
    # The entry of each line: the last one that starts in its block up to it, else in an earlier block.
    starts = heads.select("log_name", F.col("line_no").alias("start"), "head_line").withColumn("head", F.struct("start", "head_line"))
    held = parsed.join(starts.select("log_name", F.col("start").alias("line_no"), "head"), ["log_name", "line_no"], "left_outer")
    inner = Window.partitionBy("log_name", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    held = held.withColumn("own", F.last("head", ignorenulls=True).over(inner))
    sums = _blocked(starts.withColumnRenamed("start", "line_no"), block).groupBy("log_name", "block").agg(F.max("head").alias("leaves"))
    sums = parsed.select("log_name", "block").distinct().join(sums, ["log_name", "block"], "left_outer")
    earlier = Window.partitionBy("log_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("log_name", "block", F.last("leaves", ignorenulls=True).over(earlier).alias("carried"))
    held = held.join(sums, ["log_name", "block"]).withColumn("own", F.coalesce("own", "carried")).where("own is not null")
    below = F.col("line_no") > F.col("own.head_line")
    # Inside the object that starts an entry the grammar explains every line.
    size = F.length("text")
    first = F.when(below & (F.col("kind") != "rest"), F.lit(0)).otherwise(size - F.col("unparsed"))
    held = held.withColumn("first", first)
    span = F.struct("line_no", F.col("first").alias("start"), size.alias("stop"), F.expr("substring(text, first + 1)").alias("text"))
    plain = F.regexp_replace("text", r"\x1b\[[0-9;]*[A-Za-z]", "")
    texts = held.groupBy("log_name", F.col("own.start").alias("line_no")).agg(
        F.sort_array(F.collect_list(F.when(below, F.struct("line_no", plain.alias("text"))))).alias("more"),
        F.sort_array(F.collect_list(F.when(F.col("first") < size, span))).alias("unparsed"),
        F.sort_array(F.collect_list(F.when(below & F.col("kind").isin("frame", "indented"), F.struct("line_no", "kind")))).alias("below"),
    )
    out = heads.drop("head_line").join(texts, ["log_name", "line_no"])
    message = F.when(F.size("more") == 0, F.col("message")).otherwise(F.array_join(F.concat(F.array(F.coalesce("message", F.lit(""))), F.col("more.text")), "\n"))
    return out.withColumn("message", message).drop("more")


def _blocked(rows: DataFrame, block: int) -> DataFrame:
    return rows.withColumn("block", F.floor((F.col("line_no") - 1) / block))


def _assemble(parsed: DataFrame, block: int) -> DataFrame:
    """``log_entries`` of parsed lines; ``head_line`` is the last line of what starts the entry."""
    fields = ["ts_ms", "level", "component", "message"]
    ends = parsed.groupBy("log_name", "block").agg(F.max("line_no").alias("end"))
    objects = _objects(parsed.where("kind in ('open', 'member', 'close')"), fields)
    heads = parsed.where("kind = 'entry'").select("log_name", "line_no", F.col("line_no").alias("head_line"), *fields).unionByName(objects)
    heads = _blocked(heads, block)
    inner = Window.partitionBy("log_name", "block").orderBy("line_no")
    heads = heads.withColumn("next", F.lead("line_no").over(inner))
    # Per block: its first entry and last line; then, over blocks only, the first entry of any later block.
    firsts = heads.groupBy("log_name", "block").agg(F.min("line_no").alias("first"))
    blocks = ends.join(firsts, ["log_name", "block"], "left_outer")
    later = Window.partitionBy("log_name").orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("log_name")
    blocks = blocks.select("log_name", "block", F.first("first", ignorenulls=True).over(later).alias("after"), F.max("end").over(whole).alias("log_end"))
    out = heads.join(blocks, ["log_name", "block"])
    last = F.coalesce(F.col("next") - 1, F.col("after") - 1, F.col("log_end"))
    return out.select("log_name", "line_no", last.alias("last_line"), *fields, "head_line")


def _objects(parts: DataFrame, fields: list[str]) -> DataFrame:
    """Objects over several lines that are entries, at their first line."""
    # The last opening or closing line before each line: within the block, else from an earlier block.
    event = F.when(F.col("kind") == "open", F.col("line_no")).when(F.col("kind") == "close", -F.col("line_no"))
    parts = parts.withColumn("event", event)
    before = Window.partitionBy("log_name", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("prior", F.last("event", ignorenulls=True).over(before))
    sums = parts.groupBy("log_name", "block").agg(F.max_by("event", F.when(F.col("event").isNotNull(), F.col("line_no"))).alias("leaves"))
    earlier = Window.partitionBy("log_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("log_name", "block", F.last("leaves", ignorenulls=True).over(earlier).alias("carried"))
    parts = parts.join(sums, ["log_name", "block"])
    start = F.when(F.col("kind") == "open", F.col("line_no")).otherwise(F.coalesce("prior", "carried"))
    parts = parts.withColumn("start", start).where("start > 0")
    value = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line_no"))).alias(c)
    whole = parts.groupBy("log_name", "start").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("kind") == "close", F.col("line_no"))).alias("close"), *[value(c) for c in fields]
    )
    whole = whole.where("close is not null and n = close - start + 1 and ts_ms is not null and level is not null")
    return whole.select("log_name", F.col("start").alias("line_no"), F.col("close").alias("head_line"), *fields)


def markers(entries: DataFrame) -> DataFrame:
    """Phase markers among the entries: ``(log_name, line_no, ts_ms, phase_id, status, payload)``."""
    pairs = F.filter(F.split("message", r"\s+"), lambda x: x.contains("="))
    key = lambda x: F.substring_index(x, "=", 1)
    # Of a repeated key the last value counts.
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: key(y) == key(x)))
    payload = F.map_from_entries(F.transform(last, lambda x: F.struct(key(x).alias("k"), F.regexp_replace(x, r"^[^=]*=", "").alias("v"))))
    return entries.where(F.col("component").startswith("PHASE_")).select(
        "log_name", "line_no", "ts_ms", F.expr("substring(component, 7)").alias("phase_id"), F.col("level").alias("status"), payload.alias("payload")
    )
