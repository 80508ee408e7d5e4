"""Graph operators over ``edges(src, dst)``: bounded reachability, shortest paths, PageRank and degrees.

All of them are loops of joins; only counters come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, drop


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, upstream: bool = False) -> DataFrame:
    """``(id, depth)`` of every node within ``max_depth`` edges of a seed, with its smallest depth, 1 or more.

    Seeds are not visited beforehand, so a seed on a cycle, or called by another seed, is returned as well.  A
    ``max_depth`` below 1 counts as 1.  Edges with a null end lead nowhere; no seeds give no rows.
    """
    near, far = ("dst", "src") if upstream else ("src", "dst")
    # Edges aren't made distinct first: that would shuffle all of them, where only those at the frontier matter.
    # They are written once, as every round reads them and what makes them may be dear.
    step = cut(edges.where("src is not null and dst is not null").select(F.col(near).alias("at"), F.col(far).alias("to")))
    frontier = seeds.select(F.col("id").alias("at")).distinct()
    seen: DataFrame | None = None
    for depth in range(1, max(1, max_depth) + 1):
        new = step.join(frontier, "at", "left_semi").select(F.col("to").alias("id")).distinct()
        if seen is not None:
            new = new.join(seen, "id", "left_anti")
        new = cut(new.withColumn("depth", F.lit(depth)))
        seen = new if seen is None else seen.unionByName(new)
        frontier = new.select(F.col("id").alias("at"))
        if depth < max_depth and new.isEmpty():
            break
    drop(step)
    return seen


def shortest_path(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    """``(depth, path)``: one shortest path from any source to any target, at most ``max_depth`` edges long.

    A node that is both gives depth 0.  Of several shortest paths the one with the smallest ids counts.  No
    path gives no row.
    """
    ends = targets.select("id").distinct()
    frontier = sources.select("id", F.array(F.col("id")).alias("path")).distinct()
    best = lambda df: df.groupBy("id").agg(F.min("path").alias("path"))
    seen = frontier.select("id")
    step = cut(edges.where("src is not null and dst is not null").select("src", "dst"))
    for depth in range(max_depth + 1):
        hit = frontier.join(ends, "id", "left_semi").agg(F.min("path").alias("path")).where("path is not null")
        if depth == max_depth or not hit.isEmpty():
            return hit.select(F.lit(depth).alias("depth"), "path")
        nxt = frontier.join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut(best(nxt.join(seen, "id", "left_anti")))
        seen = seen.unionByName(frontier.select("id"))
    return frontier.where("false").select(F.lit(0).alias("depth"), "path")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_iterations: int = 50, eps: float = 1e-6) -> DataFrame:
    """``(id, rank)`` with ranks that sum to 1.

    Equal edges count as often as they occur, unless the caller makes them distinct.  The rank of nodes
    without outgoing edges is spread evenly.  Iteration ends when the sum of changes falls below ``eps``.
    No nodes give no rows; edges from or to unknown nodes are left out.
    """
    ids = nodes.select("id").distinct()
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    links = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    out = links.groupBy("src").agg(F.count("*").alias("deg"))
    links = cut(links.groupBy("src", "dst").agg(F.count("*").alias("w")).join(out, "src").select("src", "dst", (F.col("w") / F.col("deg")).alias("share")))
    # Partitioned once by the column that every iteration joins on, so only ranks are shuffled; what is lost
    # with an executor comes again from the written table.
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = links.repartition(parts, "src").persist()
    rank = cut(ids.join(out.select(F.col("src").alias("id"), F.lit(True).alias("linked")), "id", "left_outer").select("id", F.lit(1.0 / n).alias("rank"), F.coalesce("linked", F.lit(False)).alias("linked")))
    loose = F.coalesce(F.sum(F.when(~F.col("linked"), F.col("rank"))), F.lit(0.0))
    dangling = rank.agg(loose).first()[0]
    for _ in range(max_iterations):
        given = links.join(rank, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        base = (1 - damping) / n + damping * dangling / n
        new = cut(
            rank.join(given.withColumnRenamed("dst", "id"), "id", "left_outer")
            .select("id", (F.lit(base) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"), "linked", F.col("rank").alias("old"))
        )
        delta, dangling = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), loose).first()
        drop(rank)
        rank = new
        if delta < eps:
            break
    links.unpersist()
    total = rank.agg(F.sum("rank")).first()[0]
    return rank.select("id", (F.col("rank") / total).alias("rank"))


def file_in_degree(edges: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """``(file_id, path, in_degree)``: edges of any kind that reach a file's symbols from other files; 0 where none."""
    owner = symbols.select(F.col("id").alias("sid"), F.col("file_id").alias("fid"))
    known = edges.where("src is not null and dst is not null")
    ends = known.join(owner.select(F.col("sid").alias("src"), F.col("fid").alias("f_src")), "src").join(owner.select(F.col("sid").alias("dst"), F.col("fid").alias("f_dst")), "dst")
    counts = ends.where("f_src <> f_dst").groupBy(F.col("f_dst").alias("file_id")).agg(F.count("*").alias("in_degree"))
    return files.select(F.col("id").alias("file_id"), "path").join(counts, "file_id", "left_outer").select("file_id", "path", F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
