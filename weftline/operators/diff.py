"""Comparing two states: files by hash, symbols by signature, journals by what they leave."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, change, moved_from)`` of two states ``(path, hash)``: unchanged, dirty, moved, new or deleted.

    A new path with the hash of a path that is gone is moved; several of one hash are paired in path order and
    the rest is new or deleted.  A null hash equals nothing, so such a file is dirty, new or deleted.
    """
    both = old.select(F.col("path").alias("p"), F.col("hash").alias("old_hash")).join(new.select(F.col("path").alias("p"), F.col("hash").alias("new_hash"), F.lit(True).alias("here")), "p", "full_outer")
    there = old.select(F.col("path").alias("p"), F.lit(True).alias("there"))
    both = both.join(there, "p", "left_outer")
    kept = both.where("here and there").select(F.col("p").alias("path"), F.when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("dirty").alias("change"), F.lit(None).cast("string").alias("moved_from"))
    number = lambda h: F.row_number().over(Window.partitionBy(h).orderBy("p"))
    gone = both.where("here is null").select("p", F.col("old_hash").alias("h"), number("old_hash").alias("k"))
    come = both.where("there is null").select("p", F.col("new_hash").alias("h"), number("new_hash").alias("k"))
    pairs = come.withColumnRenamed("p", "path").join(gone.withColumnRenamed("p", "moved_from"), ["h", "k"], "full_outer")
    rest = pairs.select(
        F.coalesce("path", "moved_from").alias("path"),
        F.when(F.col("path").isNull(), "deleted").when(F.col("moved_from").isNull(), "new").otherwise("moved").alias("change"),
        F.when(F.col("path").isNotNull(), F.col("moved_from")).alias("moved_from"),
    )
    return kept.unionByName(rest)


def signature_tokens(signature):
    """Column: the distinct words of a signature."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(signature, F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0)))


CHANGES = "file string, change string, kind string, old_name string, new_name string, score double"


def diff_symbols(old: DataFrame, new: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``(file, change, kind, old_name, new_name, score)`` of two states ``(file, kind, name, line, signature)``.

    Symbols meet by file, kind and name (the last line of repeated names counts) and are unchanged or modified.
    What is left over is renamed if kinds agree and the similarity of signatures reaches ``threshold``: pairs are
    taken greedily by new symbol in order of line and name, the most similar old one first, then the nearest line.
    """
    last = lambda df: df.groupBy("file", "kind", "name").agg(F.max(F.struct("line", "signature")).alias("s")).select("file", "kind", "name", "s.*")
    o = last(old).select("file", "kind", "name", F.col("line").alias("old_line"), F.col("signature").alias("old_sig"), F.lit(True).alias("was"))
    n = last(new).select("file", "kind", "name", F.col("line").alias("new_line"), F.col("signature").alias("new_sig"), F.lit(True).alias("is"))
    both = o.join(n, ["file", "kind", "name"], "full_outer")
    none = F.lit(None).cast("double")
    same = both.where("was and is").select("file", F.when(F.col("old_sig").eqNullSafe(F.col("new_sig")), "unchanged").otherwise("modified").alias("change"), "kind", F.col("name").alias("old_name"), F.col("name").alias("new_name"), none.alias("score"))
    loose = both.where("was is null or is is null").select("file", "kind", "name", F.coalesce("new_line", "old_line").alias("line"), F.col("is").isNotNull().alias("new"), signature_tokens(F.coalesce("new_sig", "old_sig")).alias("tokens"))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        """The symbols of one file; a file holds few."""
        rows, gone = [], {i: (r.kind, r.name_, r.line, set(r.tokens)) for i, r in enumerate(pdf[~pdf["new"]].rename(columns={"name": "name_"}).sort_values(["line", "name_"]).itertuples())}
        file = pdf["file"].iloc[0]
        for r in pdf[pdf["new"]].rename(columns={"name": "name_"}).sort_values(["line", "name_"]).itertuples():
            mine, best = set(r.tokens), None
            for i, (kind, name, line, tokens) in gone.items():
                if kind != r.kind:
                    continue
                score = len(mine & tokens) / len(mine | tokens) if mine | tokens else 1.0
                key = (-score, abs((line or 0) - (r.line or 0)), line or 0, name)
                if score >= threshold and (best is None or key < best[0]):
                    best = (key, i, score)
            if best:
                rows.append((file, "renamed", r.kind, gone.pop(best[1])[1], r.name_, best[2]))
            else:
                rows.append((file, "added", r.kind, None, r.name_, None))
        rows += [(file, "removed", kind, name, None, None) for kind, name, _, _ in gone.values()]
        return pd.DataFrame(rows, columns=["file", "change", "kind", "old_name", "new_name", "score"]).astype({"score": "float64"})

    return same.unionByName(loose.groupBy("file").applyInPandas(match, CHANGES))


def replay_stats(feed: DataFrame) -> DataFrame:
    """One row ``(intents, acked, unacked, repeated)``: how far a journal was acknowledged and how often sent again."""
    sent = feed.where("not coalesce(ack, false) and id is not null").groupBy("id").agg(F.count("*").alias("n"))
    acks = feed.where("ack and id is not null").select("id").distinct().withColumn("a", F.lit(1))
    return sent.join(acks, "id", "left_outer").agg(
        F.count("*").alias("intents"), F.count("a").alias("acked"), (F.count("*") - F.count("a")).alias("unacked"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated")
    )
