"""Compact views of an index for a reader with little room: ranked symbols and the surroundings of a document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.docs import mentions
from weftline.operators.graph import pagerank
from weftline.operators.ranking import prefix_fit
from weftline.operators.relational import rank_all

#: The order in which kinds of equal rank are listed; others come last.
KIND_PRIORITY = {"function": 0, "async_function": 0, "method": 1, "async_method": 1, "class": 2, "struct": 2, "interface": 2, "type_alias": 3}
LAST_PRIORITY = 9


def ranked_symbols(symbols: DataFrame, files: DataFrame, edges: DataFrame, **options) -> DataFrame:
    """``(pos, rank, name, kind, file, line, signature)`` by PageRank, rounded to three significant digits before sorting."""
    score = pagerank(symbols.select("id"), edges.where("dst is not null").select("src", "dst"), **options)
    digits = F.format_string("%.2e", "rank").cast("double")
    table = F.create_map(*[F.lit(x) for pair in KIND_PRIORITY.items() for x in pair])
    kind = F.coalesce(F.try_element_at(table, F.col("kind")), F.lit(LAST_PRIORITY))
    rows = symbols.join(score.select("id", digits.alias("rank")), "id").join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file")), "file_id")
    rows = rows.select("id", "rank", "name", "kind", kind.alias("k"), "file", "line", "signature")
    return rank_all(rows, [F.desc("rank"), F.asc("k"), F.asc("file"), F.asc("line"), F.asc("name"), F.asc("id")], "pos").drop("k", "id")


def intel(ranked: DataFrame, budget_tokens: int = 1024) -> str:
    """The longest prefix of ranked symbols whose JSON fits the budget at four characters per token, as stable JSON.

    An item takes 60 characters at least, so that is how many rows come to the driver; the exact length is counted there.
    """
    cap = max(1, budget_tokens) * 4
    rows = [r.asDict() for r in ranked.where(F.col("pos") <= cap // 60 + 1).orderBy("pos").collect()]
    while True:
        text = json.dumps({"symbols": rows}, sort_keys=True, separators=(",", ":"), default=str)
        if len(text) <= cap or not rows:
            return text + "\n"
        rows.pop()


def fit_per_file(ranked: DataFrame, cap: int) -> DataFrame:
    """Of each file the longest prefix of its ranked symbols that fits ``cap`` characters."""
    sized = ranked.withColumn("size", F.length("name") + F.length(F.coalesce("signature", F.lit(""))))
    return prefix_fit(sized, ["file"], [F.asc("pos")], "size", cap, gap=2)


def context_pack(docs: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, ownership: DataFrame, max_depth: int = 3) -> DataFrame:
    """``(doc_id, what, name, first, detail)``: the files and symbols that a document mentions and that exist.

    Files come with their main author and that author's share, symbols with the number of symbols they reach.
    Symbols that share a name are taken together.
    """
    seen = mentions(docs)
    held = seen.join(files.select(F.col("path").alias("token"), F.col("id").alias("file_id")), "token")
    sums = ownership.groupBy("file_id").agg(F.max_by("author", F.struct("line_count", "author")).alias("author"), F.max("line_count").alias("most"), F.sum("line_count").alias("all"))
    share = F.concat(F.col("author").cast("string"), F.lit(" "), F.round(F.col("most") / F.col("all") * 100, 1).cast("string"), F.lit("%"))
    out = held.join(sums, "file_id", "left_outer").select("doc_id", F.lit("file").alias("what"), F.col("token").alias("name"), "first", share.alias("detail"))
    named = seen.join(symbols.select(F.col("name").alias("token"), "id"), "token")
    # All mentioned names in one traversal: pairs of a name and what it reaches, level by level.
    step = edges.where("kind = 'call' and src is not null and dst is not null").select("src", "dst")
    at = named.select("token", "id").distinct()
    pairs = at.where("false")
    for _ in range(max_depth):
        at = at.join(step, F.col("id") == F.col("src")).select("token", F.col("dst").alias("id")).distinct().join(pairs, ["token", "id"], "left_anti")
        pairs = pairs.unionByName(at)
    counts = pairs.groupBy("token").agg(F.count("*").alias("n"))
    names = named.select("doc_id", "token", "first").distinct().join(counts, "token", "left_outer")
    return out.unionByName(names.select("doc_id", F.lit("symbol").alias("what"), F.col("token").alias("name"), "first", F.coalesce("n", F.lit(0)).cast("string").alias("detail")))


def markdown(pack: DataFrame, doc_id: int, limit: int = 200) -> str:
    """The pack of one document as a list, cut to ``limit`` lines for its reader."""
    rows = pack.where(F.col("doc_id") == doc_id).orderBy("what", "first", "name").limit(limit).collect()
    return "".join(f"- {r.what} `{r.name}`: {r.detail or 'unknown'}\n" for r in rows)


