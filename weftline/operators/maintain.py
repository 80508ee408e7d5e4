"""Keeping stored relations: upserts, cascades, replacement, retention and incremental refresh.

Parquet has no MERGE, so each operator returns the whole new relation; ``SnapshotStore.publish`` swaps it in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.diff import classify_files, diff_symbols
from weftline.session import cut


def last_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of repeated keys the last row in the given order."""
    reverse = [c.desc_nulls_last() for c in order]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*reverse))).where("_r = 1").drop("_r")


def _matches(a: DataFrame, b: DataFrame, keys: list[str]):
    """Null-safe equality of the keys: a null key is a value like others."""
    return [a[k].eqNullSafe(b[k]) for k in keys]


def upsert(current: DataFrame, rows: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """``current`` with ``rows`` put in place of those with equal keys. Of repeated new keys the last counts, else any."""
    new = last_of(rows, keys, order) if order else rows.dropDuplicates(keys)
    return current.join(new, _matches(current, new, keys), "left_anti").unionByName(new.select(*current.columns))


def insert_new(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` and those of ``rows`` whose keys it doesn't have, once each."""
    new = rows.select(*current.columns).dropDuplicates(keys)
    return current.unionByName(new.join(current, _matches(new, current, keys), "left_anti"))


def replace_rows(current: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a key are replaced by the new rows of that key; keys without new rows are kept."""
    touched = rows.select(*keys).distinct()
    return current.join(touched, _matches(current, touched, keys), "left_anti").unionByName(rows.select(*current.columns))


def delete_files(files: DataFrame, symbols: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete ``gone(id)`` from files, with their symbols and every edge from or to those symbols."""
    lost = symbols.join(gone.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")
    kept = edges.join(lost.withColumnRenamed("id", "src"), "src", "left_anti").join(lost.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return files.join(gone.select("id"), "id", "left_anti"), symbols.join(lost, "id", "left_anti"), kept.select(*edges.columns)


def keep_newest_commits(commits: DataFrame, commit_files: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The ``n`` newest commits of each repository, ties by hash, with their files."""
    w = Window.partitionBy("repo").orderBy(F.desc_nulls_last("author_time"), "sha")
    kept = commits.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return kept, commit_files.join(kept.select(F.col("sha").alias("commit_sha")), "commit_sha", "left_semi")


def new_commits(cached: DataFrame, log: DataFrame) -> DataFrame:
    """The commits of a log that the cache doesn't have, once each."""
    return log.dropDuplicates(["sha"]).join(cached.select("sha"), "sha", "left_anti")


def refresh(files: DataFrame, symbols: DataFrame, edges: DataFrame, disk: DataFrame, parse) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bring an index up to date by parsing only what changed; equals a build of the new state.

    ``files(id, path, hash)``, ``disk(id, path, hash, content)`` and ``parse(contents(file_id, content)) ->
    (symbols, edges)`` with ids that depend on file and name alone.  Moved files keep their id and symbols; the
    ``id`` of ``disk`` counts for new files only.
    """
    change = classify_files(files.select("path", "hash"), disk.select("path", "hash"))
    old = files.select(F.col("id").alias("old_id"), F.col("path").alias("old_path"))
    there = disk.join(change.where("change <> 'deleted'"), "path")
    there = there.join(old, F.coalesce("moved_from", "path") == F.col("old_path"), "left_outer").withColumn("id", F.coalesce("old_id", "id"))
    dirty = there.where("change in ('dirty', 'new')").select(F.col("id").alias("file_id"), "content")
    new_symbols, new_edges = parse(dirty)
    same = there.where("change in ('unchanged', 'moved')").select(F.col("id").alias("file_id"))
    kept_symbols = symbols.join(same, "file_id", "left_semi")
    all_symbols = kept_symbols.unionByName(new_symbols.select(*symbols.columns))
    kept_edges = edges.join(kept_symbols.select(F.col("id").alias("src")), "src", "left_semi")
    # An edge into a symbol that is gone goes on as an unresolved one by its name.
    gone = symbols.select(F.col("id").alias("dst"), F.col("name").alias("_lost")).join(all_symbols.select(F.col("id").alias("dst")), "dst", "left_anti")
    kept_edges = kept_edges.join(gone, "dst", "left_outer").withColumn("dst_unresolved", F.coalesce("_lost", "dst_unresolved")).withColumn("dst", F.when(F.col("_lost").isNull(), F.col("dst")))
    return there.select("id", "path", "hash"), all_symbols, kept_edges.select(*edges.columns).unionByName(new_edges.select(*edges.columns)).distinct()


def refresh_parsed(files: DataFrame, parsed: DataFrame, disk: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """``(files, parsed)`` of the new state, by parsing only new and changed texts; ``build_index`` of it equals a build.

    ``files(id, path, hash)``, ``disk(id, path, hash, content)`` and ``parse(disk)`` with ``file_id`` for ``id``, which
    gives the rows of ``python_source.SCHEMA``.  Calls and imports are kept as they were read, so resolving them again
    finds what became known or unknown in other files.  Moved files keep their id.
    """
    change = classify_files(files.select("path", "hash"), disk.select("path", "hash"))
    old = files.select(F.col("id").alias("old_id"), F.col("path").alias("old_path"))
    there = disk.join(change.where("change <> 'deleted'"), "path")
    there = there.join(old, F.coalesce("moved_from", "path") == F.col("old_path"), "left_outer").withColumn("id", F.coalesce("old_id", "id"))
    there = cut(there.withColumn("content", F.when(F.col("change").isin("dirty", "new"), F.col("content"))))
    new = parse(there.where("change in ('dirty', 'new')").withColumnRenamed("id", "file_id"))
    same = there.where("change in ('unchanged', 'moved')").select(F.col("id").alias("file_id"))
    return there.select("id", "path", "hash"), parsed.join(same, "file_id", "left_semi").unionByName(new.select(*parsed.columns))


def keep_ids(old: DataFrame, symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``symbols`` and ``edges`` of a new build with the ids that the ``old`` symbols had, renamed symbols included.

    A new symbol takes the id of the old one of its file, kind and name, else of the old one that ``diff_symbols``
    finds renamed to it; else it keeps its own, or a hash of that where an old symbol has it by now.
    """
    columns = ["file_id", "kind", "name", "line", "signature"]
    shape = lambda df: df.select(F.col("file_id").cast("string").alias("file"), *columns[1:])
    renamed = diff_symbols(shape(old), shape(symbols)).where("change = 'renamed'").select("file", "kind", F.col("old_name").alias("was"), F.col("new_name").alias("name"))
    file = F.col("file_id").cast("string").alias("file")
    # Of several symbols of one name the last line counts, as in the comparison.
    was = old.groupBy(file, "kind", F.col("name").alias("was")).agg(F.max_by("id", "line").alias("old_id"))
    now = symbols.groupBy(file, "kind", "name").agg(F.max_by("id", "line").alias("id"))
    renamed = cut(renamed)
    pairs = now.join(renamed, ["file", "kind", "name"], "left_outer").withColumn("was", F.coalesce("was", "name"))
    taken = cut(pairs.join(was, ["file", "kind", "was"]).select("id", F.col("old_id").alias("to")))
    held = taken.select(F.col("to").alias("id"), F.lit(True).alias("held"))
    rest = symbols.select("id").join(taken, "id", "left_anti").join(held, "id").select("id", F.xxhash64(F.lit(1), "id").alias("to"))
    new_id = cut(taken.unionByName(rest))
    swap = lambda df, c: df.join(new_id.withColumnRenamed("id", c), c, "left_outer").withColumn(c, F.coalesce("to", c)).drop("to")
    moved = swap(symbols, "id")
    if "parent_id" in symbols.columns:
        moved = swap(moved, "parent_id")
    return moved.select(*symbols.columns), swap(swap(edges, "src"), "dst").select(*edges.columns)


def check_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are null or occur more than once, with their number: a relation is sound if there are none."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)
