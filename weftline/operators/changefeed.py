"""Applying a stream of inserts, updates and deletes: from a change feed to the current state.

Every partition upserts its entries into an embedded DuckDB table whose conflict clause compares the stored
sequence with the incoming one, so order and repetition don't matter; deletions stay as tombstones, so partial
states can be merged like entries.  This happens twice: once where the entries lie, which leaves at most one
row per key and partition, and once per bucket of keys after the shuffle.  A key with a third of all entries
is therefore spread over all tasks first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import cut, drop, new_folder
from weftline.sources.snapshots import SnapshotStore

STATE = "repo string, path string, v bigint, s bigint, sha string, dead boolean"

#: Partial states that a bucket gets on average.
BUCKET_ROWS = 50_000
#: Versions of one file that are looked at together.
RANGE = 65_536

_CREATE = "CREATE TABLE state (repo VARCHAR, path VARCHAR, v BIGINT, s BIGINT, sha VARCHAR, dead BOOLEAN, PRIMARY KEY (repo, path))"
_UPSERT = """
INSERT INTO state
SELECT repo, path, v, s, sha, dead FROM incoming
QUALIFY row_number() OVER (PARTITION BY repo, path ORDER BY v DESC, s DESC, dead, sha DESC) = 1
ON CONFLICT (repo, path) DO UPDATE SET v = excluded.v, s = excluded.s, sha = excluded.sha, dead = excluded.dead
WHERE (excluded.v, excluded.s, NOT excluded.dead, coalesce(excluded.sha, '')) > (state.v, state.s, NOT state.dead, coalesce(state.sha, ''))
"""


def _upsert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: upsert every batch, then export the states. Memory holds the keys, not their histories."""
    import duckdb

    con = duckdb.connect(config={"threads": "1"})
    con.execute(_CREATE)
    schema = None
    for batch in batches:
        if batch.num_rows:
            schema = batch.schema
            con.register("incoming", pa.Table.from_batches([batch]))
            con.execute(_UPSERT)
            con.unregister("incoming")
    if schema is not None:
        yield from con.execute("SELECT * FROM state").to_arrow_table().cast(schema).to_batches(max_chunksize=10_000)
    con.close()


def normalise(feed: DataFrame) -> DataFrame:
    """``(repo, path, v, before, sha, dead, ts)`` of every intent that changes existence or content.

    Acknowledgements (``ack`` true) and entries without ``repo`` or ``args.path`` change nothing.  ``op`` is
    compared without case, blanks or a leading ``file``; ``delete``, ``remove`` and ``unlink`` delete.  Any
    other entry with a null or empty ``content_sha`` only changes metadata and is left out.
    """
    op = F.regexp_replace(F.lower(F.trim("op")), r"^file[\s_-]*", "")
    sha = F.when(F.trim("content_sha") != "", F.col("content_sha"))
    rows = feed.where("not coalesce(ack, false)").select(
        "repo", F.col("args.path").alias("path"), F.col("prev_user_version").cast("long").alias("v"),
        F.col("args.content_hash_before").alias("before"), sha.alias("sha"), F.coalesce(op.isin("delete", "remove", "unlink"), F.lit(False)).alias("dead"), "ts",
    )
    rows = rows.where("repo is not null and path is not null and (dead or sha is not null)")
    return rows.withColumn("sha", F.when(~F.col("dead"), F.col("sha")))


def place_unversioned(changes: DataFrame) -> DataFrame:
    """Give entries without a version the sequence ``(v, s)`` of the place where their prior content was current.

    Such an entry follows the change that produced its ``before``; if that content occurred several times, the
    last occurrence that no versioned change is known to have left counts, else the last one.  Entries that
    build on other unversioned entries follow them with a larger ``s``.  What can't be placed (no or unknown
    prior content) ranks below every version, by the time it names; a versioned change always overrules it.
    """
    lost = cut(changes.where("v is null").groupBy("repo", "path", "before", "sha", "dead").agg(F.min("ts").alias("ts")))
    known = changes.where("v is not null")
    if lost.isEmpty():
        drop(lost)
        return known.select("repo", "path", "v", F.lit(0).cast("long").alias("s"), "sha", "dead")
    want = lost.where("before is not null").select("repo", "path", F.col("before").alias("content")).distinct()
    slots = _slots(known, want)
    at = cut(
        lost.join(slots.withColumnRenamed("content", "before"), ["repo", "path", "before"], "left_outer")
        .select("repo", "path", "before", "sha", "dead", "ts", "v", F.when(F.col("v").isNotNull(), F.lit(1).cast("long")).alias("s"))
    )
    # Entries that build on unversioned ones follow in rounds; each writes only what it places.
    placed, new, rest = [at.where("v is not null")], at.where("v is not null"), at.where("v is null")
    while True:
        bases = new.where("not dead").groupBy("repo", "path", F.col("sha").alias("before")).agg(F.max(F.struct("v", "s")).alias("base"))
        new = cut(
            rest.join(bases, ["repo", "path", "before"]).select(
                "repo", "path", "before", "sha", "dead", "ts", F.col("base.v").alias("v"), (F.col("base.s") + 1).alias("s")
            )
        )
        if new.isEmpty():
            break
        placed.append(new)
        done = new.select("repo", "path", "before").distinct()
        rest = rest.join(done, ["repo", "path", "before"], "left_anti")
        if len(placed) % 8 == 0:
            # So that the plan doesn't grow with the length of chains.
            rest = cut(rest)
            placed = [cut(reduce(DataFrame.unionByName, placed))]
    at = reduce(DataFrame.unionByName, placed, rest)
    drop(lost)
    when = F.coalesce(F.unix_millis(F.try_to_timestamp(F.col("ts"))), F.lit(0))
    at = at.select("repo", "path", F.coalesce("v", F.lit(-1)).alias("v"), F.coalesce("s", when).alias("s"), "sha", "dead")
    return known.select("repo", "path", "v", F.lit(0).cast("long").alias("s"), "sha", "dead").unionByName(at)


def _slots(known: DataFrame, want: DataFrame) -> DataFrame:
    """``(repo, path, content, v)``: for each wanted content the version that an entry built on it follows.

    That is the last version at which it came and that no later one is known to have left before it came again,
    else the last at which it came.  A file may go to and fro between two contents in a third of all entries, so
    its versions are looked at in ranges of ``RANGE``, and then only one row per range.
    """
    key = ["repo", "path", "content"]
    come = known.where("not dead").select("repo", "path", F.col("sha").alias("content"), "v", F.lit(True).alias("come"), F.lit(False).alias("gone"))
    gone = known.where("before is not null").select("repo", "path", F.col("before").alias("content"), "v", F.lit(False).alias("come"), F.lit(True).alias("gone"))
    block = F.floor(F.col("v") / RANGE).alias("block")
    turns = come.unionByName(gone).join(want, key, "left_semi").groupBy(*key, block, "v").agg(F.max("come").alias("come"), F.max("gone").alias("gone"))
    turns = turns.withColumn("left", F.lead("gone").over(Window.partitionBy(*key, "block").orderBy("v")))
    # Per range: its first turn, whether the last coming and the last open one, as far as the range shows.
    coming = F.when(F.col("come"), F.col("v"))
    ranges = turns.groupBy(*key, "block").agg(
        F.min_by("gone", "v").alias("first"), F.max(coming).alias("last"), F.max(F.when(~F.col("left"), coming)).alias("open"), F.max(F.when(F.col("left").isNull(), coming)).alias("end")
    )
    after = F.lead("first").over(Window.partitionBy(*key).orderBy("block"))
    ranges = ranges.withColumn("open", F.greatest("open", F.when(~F.coalesce(after, F.lit(False)), F.col("end"))))
    return ranges.groupBy(*key).agg(F.coalesce(F.max("open"), F.max("last")).alias("v")).where("v is not null")


def apply_changes(feed: DataFrame, tombstones: bool = False) -> DataFrame:
    """The files that exist after all changes: ``(repo, path, content_sha)``, one row per file.

    ``feed`` has the columns of a write-ahead log: repo, ts, op, args, prev_user_version, content_sha, ack.
    The last change by version decides; a change that is repeated, retried or late has no further effect.  Two
    different changes with one version, which a correct feed doesn't have, are resolved towards existence and
    then the larger hash.  With ``tombstones`` deleted files come too, with ``deleted`` true.  An empty feed
    gives an empty result; extra columns are ignored.
    """
    changes = place_unversioned(normalise(feed)).select("repo", "path", "v", "s", "sha", "dead")
    partial = cut(changes.mapInArrow(_upsert, STATE))
    buckets = max(1, -(-partial.count() // BUCKET_ROWS))
    state = partial.repartition(buckets, "repo", "path").mapInArrow(_upsert, STATE)
    if tombstones:
        return state.select("repo", "path", F.col("sha").alias("content_sha"), F.col("dead").alias("deleted"), F.col("v").alias("version"))
    return state.where("not dead").select("repo", "path", F.col("sha").alias("content_sha"))


def publish_changes(feed: DataFrame, store, relation: str = "files") -> int:
    """Apply the feed and publish the files that exist as the next version of a ``SnapshotStore``; returns the version.

    All buckets are written beside the current version and become visible together, by one rename.
    """
    return store.publish({relation: apply_changes(feed)})


def current_files(feed: DataFrame) -> DataFrame:
    """``apply_changes``, published in the shared folder and read from the published version."""
    store = SnapshotStore(feed.sparkSession, new_folder(feed.sparkSession))
    publish_changes(feed, store)
    return store.read("files")
